import math
import re
from functools import lru_cache

from marlstone.llm import tokencount as t
from marlstone.llm.common import documents


def slow_count(word, pieces):
    """Best (score, -tokens) by plain recursion over the last piece."""

    @lru_cache(None)
    def best(i):
        if not i:
            return 0.0, 0
        c = word[i - 1]
        found = []
        if c not in pieces:
            s, n = best(i - 1)
            found.append((s + len(c.encode()) * t.BYTE_SCORE, n - len(c.encode())))
        for j in range(i):
            if word[j:i] in pieces:
                s, n = best(j)
                found.append((s + pieces[word[j:i]], n - 1))
        return max(found)

    for i in range(len(word)):
        best(i)
    return -best(len(word))[1]


def test_counts_equal_plain_dynamic_programming(spark, sample):
    pieces = t.load_pieces(t.vocabulary())
    rows = documents(spark, sample).select("doc_id", "text").limit(60).collect()
    cache = {}

    def slow(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for w in set(words) - set(cache):
            cache[w] = slow_count(t.MARK + w, pieces)
        return len(words), sum(cache[w] for w in words)

    counter = t.TrieCounter(pieces, table=100)
    got = [x for i in range(0, len(rows), 7) for x in counter.totals([r.text.encode() for r in rows[i : i + 7]])]
    assert got == [slow(r.text) for r in rows]


def test_shared_prefixes_are_computed_once():
    c = t.TrieCounter({"a": -1.0, "ab": -1.5, t.MARK: -1.0, t.MARK + "a": -1.2})
    c.learn({b"abc", b"abd", b"ab"})
    assert c.nodes == 5 and c.terminal[b"ab"] == slow_count(t.MARK + "ab", c.pieces)


def test_the_trie_is_kept_and_its_bounds_change_nothing():
    pieces = t.load_pieces(t.vocabulary())
    words = [f"{a}{b}{c}".encode() for a in ("under", "over", "日本") for b in ("stand", "take", "x" * 90) for c in ("", "ing", "er", "ings")]
    kept, small = t.TrieCounter(pieces), t.TrieCounter(pieces, table=3, most_nodes=10)
    for w in words:
        assert list(kept.totals([w])) == list(small.totals([w])) == [(1, slow_count(t.MARK + w.decode(), pieces))]
    before = kept.nodes
    kept.learn({words[0]})
    assert kept.nodes - before == len(t.MARK + words[0].decode()) - t.KEPT and small.held <= 10 + 36 * t.KEPT
    long = b"ab" * 200
    kept.learn({long, long + b"c"})
    assert kept.terminal[long] == slow_count(t.MARK + "ab" * 200, pieces)


def test_edge_rows(docs):
    df = docs([(1, None), (2, ""), (3, " \t\n"), (None, "hello world"), (4, "a" * 5000), (4, "a" * 5000), (5, "日本 \U0001f600 é\x00")])
    pieces = t.load_pieces(t.vocabulary())
    got = sorted((str(r.doc_id), r.n_words, r.n_tokens) for r in t.count_tokens(df, t.vocabulary()).collect())
    n = slow_count(t.MARK + "a" * 300, pieces)
    assert got[:3] == [("1", 0, 0), ("2", 0, 0), ("3", 0, 0)] and got[3] == got[4] and got[3][2] > n and math.isfinite(got[5][2])
    assert ("None", 2, slow_count(t.MARK + "hello", pieces) + slow_count(t.MARK + "world", pieces)) in got
    assert t.count_tokens(docs([]), t.vocabulary()).count() == 0
