from datetime import datetime, timedelta
from math import comb

from quire.llm import ranking

SCHEMA = "hit_id long, question_id long, chunk_rowid long, document_id string, leg string, score double, snippet string, logged_at timestamp, rho double, key double"
T0 = datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(n, q, c, "d", leg, s, None, T0 + timedelta(seconds=t), 0.0, 0.0) for n, (q, c, leg, s, t) in enumerate(rows)], SCHEMA)


def brute(rows):
    last = {}
    for n, (q, c, leg, s, t) in enumerate(rows):
        if None in (q, c, leg, s) or s != s:
            continue
        if (q, c, leg) not in last or (t, n) > last[q, c, leg][0]:
            last[q, c, leg] = ((t, n), -s if leg in ranking.HIGHER_IS_BETTER else s)
    out = {}
    for q in {k[0] for k in last}:
        mine = {(c, leg): v[1] for (qq, c, leg), v in last.items() if qq == q}
        chunks, legs = {c for c, _ in mine}, {leg for _, leg in mine}
        rows_ = []
        for c in chunks:
            r = []
            for leg in legs:
                if (c, leg) not in mine:
                    r.append(1.0)
                    continue
                v, all_ = mine[c, leg], [x for (_, le), x in mine.items() if le == leg]
                r.append((sum(x < v for x in all_) + (sum(x == v for x in all_) + 1) / 2) / len(chunks))
            r.sort()
            n = len(r)
            p = min(sum(comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(k, n + 1)) for k, x in enumerate(r, 1))
            rows_.append((round(min(1, p * n), 12), round(sum(r) / n, 12), c))
        for pos, (_, _, c) in enumerate(sorted(rows_), 1):
            out[q, c] = pos
    return out


def rows_of():
    rows = []
    for q in (1, 2):
        for c in range(12):
            rows.append((q, c, "lexical", -10.0 + (c * 7 + q) % 5, 0))
            rows.append((q, c, "semantic", 0.1 * ((c * 5) % 12), 0))
            if c % 2:
                rows.append((q, c, "popularity", float(10 ** (c % 7)), 0))
            if c % 3:
                rows.append((q, c, "rerank", c - 6.0, 0))
    rows += [(1, 3, "lexical", -99.0, 60), (1, 3, "lexical", -99.0, 60), (1, 4, "rerank", None, 90), (2, 5, "rerank", float("nan"), 90), (None, 5, "rerank", 1.0, 0), (3, 1, "lexical", 1.0, 0)]
    return rows


def test_equals_brute_force(spark):
    rows = rows_of()
    got = {(r.question_id, r.chunk_rowid): r.position for r in ranking.aggregate_ranks(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_scale_and_outliers_do_not_matter(spark):
    rows = rows_of()
    wild = [(q, c, leg, s if leg != "popularity" or s is None else s * 1e9, t) for q, c, leg, s, t in rows]
    a = {tuple(r) for r in ranking.aggregate_ranks(frame(spark, rows)).collect()}
    assert a == {tuple(r) for r in ranking.aggregate_ranks(frame(spark, wild)).collect()}


def test_empty(spark):
    assert ranking.aggregate_ranks(frame(spark, [])).count() == 0
    assert ranking.aggregate_ranks(frame(spark, [(1, 1, "lexical", None, 0)])).count() == 0
