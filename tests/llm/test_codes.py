"""Vector codes against plain loops over whole integers."""

import numpy as np

from tallyloom.llm.codes import LARGEST, decode, encode, integers, nearest, train, with_label_error


def plain(vectors, parts, entries, rounds):
    """(codebooks, codes, errors) by loops in Python integers."""
    length = -(-max(map(len, vectors)) // parts)
    cut = [[(v + [0] * (parts * length))[p * length : (p + 1) * length] for p in range(parts)] for v in vectors]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda p, x: min((dist(x, e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        at = [[best(p, c[p])[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for i in range(len(books[p])):
                own = [c[p] for c, a in zip(cut, at, strict=True) if a[p] == i]
                if own:
                    books[p][i] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    hits = [[best(p, c[p]) for p in range(parts)] for c in cut]
    return books, ["".join(f"{i:02x}" for _, i in h) for h in hits], [sum(d for d, _ in h) for h in hits]


def test_equals_plain_loops(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=7 if i % 9 else 4)], i % 3 or None) for i in range(300)]
    rows += [(400, [float("nan")] * 7, 1), (401, None, 1), (402, [1.0, None], 1), (403, [1e30] + [0.0] * 6, 1), (404, [0.0, 5.0, 0.0], 2), (404, [0.0, 5.0, 0.0], 2)]
    kept = integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), 256).repartition(5)
    books = train(kept, parts=3, entries=10, rounds=3)
    got = sorted(map(tuple, with_label_error(encode(kept, books)).select("vec_id", "code", "error", "label", "label_error").collect()), key=lambda r: (r[0], r[1]))
    used = sorted([r for r in rows if r[1] and r[0] not in (400, 402, 403)], key=lambda r: r[0])
    ints = [[int(np.floor(256 * float(np.float32(x)))) for x in v] for _, v, _ in used]
    want, codes, errors = plain(ints, 3, 10, 3)
    assert books.entries.tolist() == want
    assert [g[:3] for g in got] == [(r[0], c, e) for r, c, e in zip(used, codes, errors, strict=True)]
    sums = {}
    for r, e in zip(used, errors, strict=True):
        sums[r[2]] = sums.get(r[2], 0) + e
    assert all(g[4] == sums[g[3]] for g in got)
    for v, (_, code, error, *_) in zip(ints, got, strict=True):
        assert sum((a - b) ** 2 for a, b in zip(v + [0] * 9, decode(code, books), strict=False)) == error


def test_products_are_exact_at_the_limit():
    big = LARGEST - 1
    x = np.array([[[big, -big, big], [0, 0, 1]]])
    books = np.array([[[-big, big, -big], [big, -big, big - 1], [big, -big, big - 1]]])
    at, squared = nearest(x, books)
    assert at.tolist() == [[1, 1]] and squared.tolist() == [[1, big**2 + big**2 + (big - 2) ** 2]]


def test_no_rows(spark):
    assert train(integers(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), 256)) is None
