"""Small corpora with the awkward cases, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog. The quick brown fox jumps over the lazy dog."),
    (2, ""), (3, None), (4, " \t\n "), (5, "one"), (6, "two words"),
    (7, "The quick brown fox jumps over the lazy dog. The quick brown fox jumps over the lazy dog."),
    (8, "Éa ñandú ß 日本語   x　y <|endoftext|> don't it's 3.14 #*$%&|<>\r\nnext\n\n\nlast"),
    (9, "x" * 5000), (10, "lazy dog " * 900), (None, "The quick brown fox jumps over the lazy dog."),
    (11, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."),
    (11, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."),
    (12, "mail jo.30@mail1.example.com or +1 (788) 555-2942, ip 10.0.0.7, card 4981021525375367, Mrs. Anna Schmidt"),
    (13, "a\x00b \x1c c \x85 d"),
]


def families(seed: int, n_families: int = 4, members: int = 25) -> list[tuple[int, str]]:
    """Families of edited, cut and repeated texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    texts = []
    for _ in range(n_families):
        base = [rng.choice(words) for _ in range(rng.choice([2, 40, 120, 250]))]
        now = base
        for _ in range(members):
            x = list(now if rng.random() < 0.5 else base)
            if rng.random() < 0.3:
                x = x[: max(1, int(len(x) * rng.uniform(0.7, 1)))]
            for _ in range(int(len(x) * rng.uniform(0, 0.06))):
                x[rng.randrange(len(x))] = rng.choice(words)
            if rng.random() < 0.2:
                now = x
            texts.append(" ".join(x))
    texts += texts[:5]
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts))


def frame(spark, rows):
    """(doc_id, text) with columns whose names clash with those that operators use inside."""
    made = [(i, t, "src", "en", 0) for i, t in rows]
    return spark.createDataFrame(made, "doc_id long, text string, source string, host string, tie int").repartition(3)


def lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def space_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def near_components(rows, k: int, percent: int):
    sets = []
    for _, t in rows:
        w = space_words(lower(t or ""))
        sets.append(frozenset(zip(*[w[j:] for j in range(k)])) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and None not in (rows[i][0], rows[j][0]) and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups: dict = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted(((rows[i][0], len(sets[i]), min(groups[find(i)], default=None) if rows[i][0] is not None else None) for i in range(len(rows))), key=repr)


def long_repeats(rows, span: int = 50):
    first: dict = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - span + 1 if i is not None else 0):
            first[b[p : p + span]] = min(i, first.get(b[p : p + span], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - span + 1 if i is not None else 0):
            if first[b[p : p + span]] < i:
                gone[p : p + span] = b"\1" * span
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def repeat_words(text: str | None) -> int:
    w = space_words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return len({i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)})


def window_hits(docs, items, size: int = 10):
    windows: dict = {}
    for item, t in items:
        w = plain_words(t)
        take = min(size, len(w))
        for i in range(len(w) - take + 1 if take else 0):
            windows.setdefault(tuple(w[i : i + take]), set()).add(item)
    out = []
    for i, t in docs:
        w, hit, found = plain_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                holders = windows.get(tuple(w[p : p + n]))
                if holders:
                    hit.update(range(p, p + n))
                    found |= holders
        found -= {None}
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)
