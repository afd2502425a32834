import re
from collections import Counter

from quire.llm import terms


def test_trie_counts_through_bursts():
    trie = terms.BurstTrie(limit=4)
    words = [f"{a}{b}{c}" for a in "ab" for b in "abcd" for c in "abcde"] + ["a", "ab", "abc"] * 3
    want = Counter()
    for n, w in enumerate(words):
        trie.add(w, n, 1)
        want[w] += n
    got = {t: c[0] for _, held in trie.containers() for t, c in held.items()}
    assert got == {w: want[w] for w in set(words)} and len(trie) == len(got)
    assert all(t.startswith(prefix) for prefix, held in trie.containers() for t in held)
    assert sum(len(held) for _, held in trie.containers()) == len(got)


def test_containers_are_cut_at_route_bounds():
    packed = terms._pack([("a", ["aa", "ab", "b1", "ba", "c"], [[n, 1] for n in range(5)])])
    (out,) = terms._routed(["ab", "b", "bz"])(iter([packed]))
    got = [(r["route"], list(terms._unpack(r))) for r in out.to_pylist()]
    assert got == [(0, [("aa", 0, 1)]), (1, [("ab", 1, 1)]), (2, [("b1", 2, 1), ("ba", 3, 1)]), (3, [("c", 4, 1)])]


def test_long_common_prefixes_and_full_tries(spark):
    long = "x" * 300
    texts = [" ".join(f"{long}{n}" for n in range(k, k + 50)) for k in range(0, 400, 20)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    want = Counter()
    for t in texts:
        want.update(t.split())
    for most in (30, 500_000):
        got = {r.term: r.n for r in terms.term_frequencies(df, most_terms=most).collect()}
        assert got == want


def test_equals_brute_force(spark):
    texts = ["The cat, the dog; the CAT.", "dog 42 42 ½", "Größe größe straße_ö", None, "", "の日本 日本", "zebra " * 5000] + [f"the word{n}" for n in range(40)] + ["the cat"] * 3
    df = spark.createDataFrame([(n, t, "x", 0) for n, t in enumerate(texts)], "id long, text string, term string, n int")
    n, docs = Counter(), Counter()
    for t in texts:
        found = re.findall(r"[^\W_]+", (t or "").lower())
        n.update(found)
        docs.update(set(found))
    got = {r.term: (r.n, r.records, r.mark) for r in terms.term_frequencies(df).collect()}
    mark = lambda r: "rare" if r <= 2 else "common" if r > 0.1 * len(texts) else None
    assert got == {w: (n[w], docs[w], mark(docs[w])) for w in n}


def test_empty(spark):
    assert terms.term_frequencies(spark.createDataFrame([], "id long, text string")).count() == 0
    assert terms.term_frequencies(spark.createDataFrame([(1, None)], "id long, text string")).count() == 0
