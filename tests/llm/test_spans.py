"""All spans of op4, the added ones too, against a plain version of candidates, votes and choice."""

import random

import regex
from test_texts import BITS, digits, luhn

from varstrata.llm import pii

MORE = ["phone: (212) 555-0199", "server 2001:db8:0:1:1:1:1:1 up", "api_key = 9f86d081884c7d659a2feaa0c55ad015", "call 030 123 4567", "card 378282246310005", "visa 4222222222222", "order 1234 567 8901", "joe [at] ex [dot] com", "my-long-file-name-of-2024-v2", "ghp_0123456789abcdefABCDEF", "version 1.2.3.4", "999.1.2.3", "Kontakt: x@y.zz", "tel 212-555-0100."]


def has(pattern, text):
    return regex.search(pattern, text, regex.A) is not None


def base_ok(kind, t):
    if kind == pii.IP:
        return all(int(x) <= 255 for x in t.split("."))
    if kind == pii.CARD:
        return 16 <= len(digits(t)) <= 19 and luhn(digits(t))
    return 8 <= len(digits(t)) <= 15 if kind == pii.PHONE else True


def vote(yes, no=None):
    return 1 if yes else (-1 if no is None or no else 0)


def voted(kind, wider, ok, t, before, after):
    if kind == pii.SECRET:
        form = vote(has("^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|(?:ghp|gho|sk|pk|xox[abp])[_-].*|AKIA.*)$", t), has("^[0-9-]+$|[_/-]{2}|^[a-z]+(?:[-_/][a-z]+)+[-_/]?[0-9]*$", t))
    elif kind == pii.CARD:
        form = vote(ok, not (13 <= len(digits(t)) <= 19 and luhn(digits(t))))
    elif wider:
        form = vote(t.count(":") == 7 or has(r"@|\[at\]|\(at\)|^\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}$", t), False)
    else:
        form = vote(ok)
    known = {
        pii.EMAIL: lambda: vote((regex.search("([A-Za-z0-9-]+)$", t) or [""])[0].lower() in pii.ENDINGS),
        pii.IP: lambda: vote(False, has(r"^(?:0+|127|255)\.", t)),
        pii.CARD: lambda: vote(has(pii.ISSUERS, digits(t))),
        pii.PHONE: lambda: vote(has(pii.COUNTRIES, t), t.startswith("+")),
        pii.SECRET: lambda: vote(has(pii.KEY_NAMES, regex.sub("[\"'`]$", "", before))),
    }[kind]()
    around = f"{before} {after}".lower()
    return form, vote(not has(r"[\w.]$", before) and not has(r"^(?:[A-Za-z0-9_@]|[.,-][0-9])", after)), known, vote(has(pii.CUES[kind], around), has(pii.COUNTER, around))


def plain_candidates(text):
    out = []
    if not has(r"[0-9@]|[\[({]at[\])}]", text):
        return out
    for wider, patterns, hints in ((False, pii.BASE, pii.HINT), (True, pii.WIDER, pii.WIDER_HINT)):
        for kind, pattern in patterns.items():
            spots = [m.span() for m in regex.finditer(pattern, text, regex.A)] if has(hints[kind], text) else []
            for k, (s, e) in enumerate(spots):
                begin, end = (spots[k - 1][1] if k else 0), (spots[k + 1][0] if k + 1 < len(spots) else len(text))
                t, before, after = text[s:e], text[begin:s][-pii.AROUND :], text[e:end][: pii.AROUND]
                ok = not wider and kind in pii.BASE and base_ok(kind, t)
                size = 0 if e - s < 10 else 1 if e - s < 16 else 2 if e - s < 24 else 3
                out.append((s, e, kind, ok, *voted(kind, wider, ok, t, before, after), size))
    base = [c for c in out if c[3]]
    return [c for c in out if c[3] or not any(b[0] < c[1] and c[0] < b[1] for b in base)]


def test_added_spans(spark):
    rnd = random.Random(11)
    texts = [rnd.choice([" ", ", ", "\n"]).join(rnd.choice(BITS + MORE * 2) for _ in range(rnd.randint(0, 14))) for _ in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cands = [plain_candidates(t) for t in texts]
    counts = {}
    for c in (c for row in cands for c in row):
        key = (c[2], *c[4:])
        counts[key] = counts.get(key, 0) + 1
    weights = pii.train(sorted(counts.items()))
    added = 0
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(docs)).collect()}
    for k, row in enumerate(cands):
        spans, end = [(c[2], c[0], c[1]) for c in row if c[3]], 0
        for c in sorted((c for c in row if not c[3]), key=lambda c: (c[0], c[1], c[2])):
            z = sum(a * b for a, b in zip(weights[c[2]], pii._inputs((c[2], *c[4:])), strict=True))
            if z > 0 and not (c[2] in pii.CHECKED and c[4] < 0) and c[0] >= end:
                spans.append((c[2], c[0], c[1]))
                end = c[1]
                added += 1
        assert got[k] == ",".join(f"{pii.KINDS[kind]}:{s}:{e}" for kind, s, e in sorted(spans)), texts[k]
    assert added > 100
