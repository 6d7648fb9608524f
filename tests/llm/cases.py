"""Small tables with the awkward cases, and plain versions of the operators to hold results against."""

import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, doc string, size int"
SPACE = re.compile(r"[\x20\x09-\x0d]+")


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghijklmnoprstu", k=r.randint(2, 9))) for _ in range(n)]
    return " ".join(w.capitalize() + "." if k % 9 == 8 else w for k, w in enumerate(words))


def documents() -> list[tuple]:
    """Copies, near copies, shared passages, ties, repeated rows, nulls, blanks and a long text."""
    passage, base = prose(1, 60), prose(2, 120)
    near = base.split()
    texts = {n: prose(100 + n, 40 + n) for n in range(1, 9)}
    texts |= {10: base, 11: base, 12: " ".join([*near[:60], "changed", *near[61:]]), 13: " ".join(near[:90]), 14: " ".join(near[30:])}
    texts |= {20 + n: f"{prose(30 + n, 30)}\n{passage}\n{prose(60 + n, 25)}" for n in range(4)}
    texts |= {30: "", 31: None, 32: " \t\n", 33: "one two", 34: "One  TWO", 35: "é" * 150 + passage, 36: "ab " * 200, 37: "ab " * 90, 38: prose(5, 6000), 39: "é" * 90 + passage[:40]}
    rows = [(k, t, "en", f"s{k % 3}" if k % 5 else None, 7, "x", "y", 1) for k, t in texts.items()]
    rows += [r for r in rows if r[0] in (3, 10)]  # repeated rows
    return [*rows, (None, prose(77, 30), None, None, None, None, None, None)]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in SPACE.split(low) if w]
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def components(rows):
    """(set size, component) by id, of all pairs."""
    sets, top = {}, {}
    for r in rows:
        sets[r[0]] = shingles(r[1])
        top[r[0]] = r[0]
    low = lambda k: float("-inf") if k is None else k
    changed = True
    while changed:
        changed = False
        for a, x in sets.items():
            for b, y in sets.items():
                if x and y and 100 * len(x & y) >= 75 * len(x | y) and low(top[a]) < low(top[b]):
                    top[b], changed = top[a], True
    return {k: (len(sets[k]), top[k]) for k in sets}


def removed(rows):
    """(bytes, removed, spans, digest of the rest) by id; one row for an id."""
    seen, out = set(), {}
    for k, text in sorted({(r[0], r[1]) for r in rows}, key=lambda r: float("-inf") if r[0] is None else r[0]):
        data = (text or "").encode()
        gone = [False] * len(data)
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = [True] * 100
            seen.add(data[p : p + 100])
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out[k] = len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()
    return out
