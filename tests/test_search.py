import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomsearch.operators import frontier, search, wordcount
from loomsearch.operators import ranking as R
from loomsearch.plans.compile import matching, matching_sets
from loomsearch.plans.query import All, Any, Phrase, Without, Word, parse, ranking_leaves
from loomsearch.sources import files
from loomsearch.sources import index as ix


def make(spark, tmp, docs):
    rows = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(docs)], "doc_id bigint, text string, lang string, source string")
    return ix.write(ix.corpus_from_documents(rows), str(tmp))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    return [" ".join(rng.choices("apple banana cherry date fig".split(), [8, 4, 2, 1, 1], k=rng.randint(0, 60))) for _ in range(60)]


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    return make(spark, tmp_path_factory.mktemp("index") / "i", corpus)


def holds(node, words):
    match node:
        case Word(t):
            return t in words
        case Phrase(ts):
            return any(words[k:k + len(ts)] == list(ts) for k in range(len(words)))
        case All(parts):
            return all(holds(p, words) for p in parts)
        case Any(parts):
            return any(holds(p, words) for p in parts)
        case Without(wanted, unwanted):
            return holds(wanted, words) and not any(holds(p, words) for p in unwanted)


QUERIES = ["fig", "apple banana", "date OR fig", "apple NOT date fig", '"banana cherry"', '"apple banana apple"', "(date OR fig) AND cherry NOT banana", "absent", "apple NOT absent", "'fig' | \"date apple\""]


@pytest.mark.parametrize("text", QUERIES)
def test_matches(index, corpus, text):
    node = parse(text)
    want = {k for k, t in enumerate(corpus) if holds(node, t.split())}
    assert {r.doc_idx for r in matching(index.postings, node).collect()} == want
    assert {r.doc_idx for r in matching_sets(index.postings, node).collect()} == want


def brute_dynamic(words, terms):
    at = {t: [k + 1 for k, w in enumerate(words) if w == t] for t in terms}
    if len(terms) == 1:
        return 0
    anchor = next((t for t in terms if at[t]), None)
    short = top = near = 0
    for a in at.get(anchor, []):
        span = sum(min((abs(p - a) for p in at[t]), default=1000) for t in terms if t != anchor)
        near += a < 256
        if 0 < span < len(terms) * (len(terms) + 1):
            short += 1
            top += a < 256
    return 32 * min(8, short) + near + 16 * min(8, top)


@pytest.mark.parametrize("text", ["apple banana", "cherry date apple", "fig OR date", '"banana cherry" apple', "fig"])
def test_dynamic_rank(index, corpus, text):
    node = parse(text)
    terms = [t for leaf in ranking_leaves(node) for t in leaf]
    got = {r.doc_idx: r.s for r in matching(index.postings, node).select("doc_idx", R.dynamic_rank(F.col("m"), terms).alias("s")).collect()}
    assert got == {k: brute_dynamic(corpus[k].split(), terms) for k in got}


@pytest.mark.parametrize("url, leaves, points", [
    ("https://apple.com/", [["apple"]], 256), ("https://apple.io/x", [["apple"]], 256), ("https://averylonghostname.com/apple", [["apple"]], 256), ("https://x.org/" + "y" * 20 + "/apple", [["apple"]], 0),
    ("https://x.org/appleappleappleapple", [["appleappleapple"]], 128), ("https://ab-cd.org/", [["ab", "cd"]], 64 + 128), ("https://x.org/ab_cd", [["ab", "cd"]], 128 + 64), ("none", [["apple"]], 0)])
def test_url_score(spark, url, leaves, points):
    assert R.with_url_scores(spark.createDataFrame([(url,)], "url string"), leaves).first().url_score == points


def test_single_word_bonus(spark):
    rows = [("https://en.wikipedia.org/wiki/apple", 1000), ("https://en.wikipedia.org/wiki/apples", 0), ("https://dictionary.com/apple/x", 1000), ("https://x.org/apple", 0), ("https://en.wikipedia.org/pineapple/apple", 0)]
    parts = R.with_url_scores(spark.createDataFrame([(u,) for u, _ in rows], "url string"), [["apple"]])
    got = [r.s for r in parts.select(R.single_word_bonus(F.col("url_host"), F.col("url_path"), "apple").alias("s")).collect()]
    assert got == [s for _, s in rows]


def test_search_order_paging_and_errors(index):
    top = [tuple(r) for r in search.search(index, "apple banana").collect()]
    assert len(top) == 32 and top == sorted(top, key=lambda r: (-r[3], r[0], r[1]))
    pages = [[tuple(r) for r in search.page(search.search(index, "apple banana"), n).collect()] for n in (1, 2, 3, 4, 5)]
    assert list(itertools.chain(*pages)) == top and [len(p) for p in pages] == [10, 10, 10, 2, 0]
    assert search.search(index, "NOT apple").count() == 0 and search.search(index, "").count() == 0
    assert search.search(index, "apple banana", anchor="rarest", static_weight=1, title_weight=1).count() == 32


def test_single_term_prune(spark, tmp_path):
    rows = spark.createDataFrame([(1, "apple", "en", "s"), (2, "apple", "en", "s" * 60)], "doc_id bigint, text string, lang string, source string")
    index = ix.write(ix.corpus_from_documents(rows), str(tmp_path / "i"))
    assert [r.doc_idx for r in search.search(index, "apple").collect()] == [1] and search.matches(index, "apple").count() == 2


def test_postings_like_the_reference_scenarios(spark, tmp_path):
    index = make(spark, tmp_path / "a", ["apple banana apple apple banana"])
    first = lambda pos: [r.pos for r in ix.find(index.postings, "apple", 0, pos).collect()]
    assert [first(p) for p in (0, 1, 2, 3, 4, 5)] == [[1], [1], [3], [3], [4], []]
    assert ix.find(index.postings, "cherry").count() == 0
    assert [r.pos for r in ix.positions_between(index.postings, "apple", 0, 1, 4).collect()] == [3]
    docs = ["word apple word" if k % 5 == 0 else "word word test" for k in range(2000)]
    many = make(spark, tmp_path / "b", docs)
    assert search.matches(many, "word apple").count() == 400
    assert many.docs.count() == 2000 and ix.load(spark, str(tmp_path / "b"), [0, 9]).docs.count() == 400
    assert ix.lookup(many.docs, search.matches(many, "apple")).select("url").distinct().count() == 400


def test_long_list(spark, tmp_path):
    index = make(spark, tmp_path / "l", ["apple " * 16384])
    for pos in (1, 3, 8192, 8193, 16384):
        assert ix.find(index.postings, "apple", 0, pos).first().pos == pos


def test_titles_share_positions(spark, tmp_path):
    pages = spark.createDataFrame([(1, "https://a.org/", "<html lang='en'><title>Red Fox</title><p>quick fox"), (2, "https://b.org/", "<html lang=fr><p>fox")], "page_id bigint, url string, html string")
    index = ix.write(ix.corpus_from_pages(pages), str(tmp_path / "i"))
    assert sorted((r.term, r.field, r.positions) for r in index.postings.collect()) == [("fox", "body", [4]), ("fox", "title", [2]), ("quick", "body", [3]), ("red", "title", [1])]
    assert [r.rank for r in search.search(index, "fox", title_weight=1).collect()][0] == [r.rank for r in search.search(index, "fox").collect()][0] + 1


def test_empty_index(spark, tmp_path):
    index = ix.write(ix.corpus_from_pages(spark.createDataFrame([], "page_id bigint, url string, html string")), str(tmp_path / "i"))
    assert search.search(index, "fox", anchor="rarest").count() == 0 and index.dictionary.count() == 0


def test_shards_and_summary(spark):
    rows = spark.createDataFrame([(1, 10, "u", 5), (0, 11, "u", 3), (1, 12, "v", 9)], "shard int, doc_idx bigint, url string, rank int")
    assert [(r.url, r["rank"]) for r in search.merge_shards(rows).collect()] == [("v", 9), ("u", 3)]
    total = search.summary(spark.createDataFrame([(0, 3, 0.5), (1, 4, 0.25)], "shard int, matches bigint, seconds double")).first()
    assert total.line == "Found 7 matches in 0.500 seconds"
    reply = search.response(spark.createDataFrame([("https://a.org/x?y", 3), ("", 1)], "url string, rank int")).collect()
    assert [r.json for r in reply] == ['{"url":"https://a.org/x?y","title":"a.org/x","snippet":"","rank":3}']
    assert spark.range(1).select(search.read_request(F.lit('{"query": "a b"}')).alias("q")).first().q.query == "a b"


def test_snippets(spark):
    rows = [("https://a.org/p?q", ["A", "&amp;", "B"], ["d"] * 40), ("https://b.org/", ["Page", "Not", "Found"], ["x"]), ("https://c.org/", [], ["page", "not", "found"]), ("http://d.org/", ["http://d"], ["ok"])]
    got = {r.url: (r.title, r.snippet) for r in search.snippets(spark.createDataFrame(rows, "url string, title_words array<string>, description array<string>")).collect()}
    assert got["https://a.org/p?q"] == ("A & B", " ".join(["d"] * 30)) and got["https://b.org/"] == ("b.org/", "x") and got["https://c.org/"] == ("c.org/", "") and got["http://d.org/"][0] == "d.org/"


def test_frontier(spark, tmp_path):
    found = spark.createDataFrame([(f"http://h{k % 3}.org/{k}", k % 7) for k in range(30)], "url string, rank bigint")
    assert frontier.fresh(found, found.limit(10)).count() == 20
    hosted = found.withColumn("host", F.regexp_extract("url", "//([^/]*)", 1))
    assert frontier.cap_hosts(hosted, 4).count() == 12
    queue, rest = frontier.refill(found, 20, 5)
    assert queue.count() == 5 and rest.count() == 25 and queue.agg(F.min("rank")).first()[0] >= 4
    frontier.save(hosted, str(tmp_path / "f"))
    assert sorted(map(tuple, frontier.restore(spark, str(tmp_path / "f")).collect())) == sorted((r.url, r.host, r["rank"]) for r in hosted.collect())
    lines = spark.createDataFrame([("http://a.org/",), ("",), (" http://b.org ",)], "value string")
    assert sorted((r.host, r["rank"]) for r in frontier.seeds(lines).collect()) == [("a.org", 10), ("b.org", 10)]


def test_files(spark, tmp_path):
    (tmp_path / "j").write_text('{"url":"u1","rank":1,"content":"a b"}\n\n{bad\n{"url":"u2","rank":2,"content":["c","d"]}\n')
    assert sorted((r.url, r.content) for r in files.json_lines(spark, str(tmp_path / "j")).collect()) == [("u1", ["a", "b"]), ("u2", ["c", "d"])]
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "x.txt").write_text("one two\nthree\n")
    (tmp_path / "d" / "e" / "y.txt").write_text("four\n\n")
    assert [r.path.rsplit("/", 1)[-1] for r in files.listing(spark, str(tmp_path / "d")).collect()] == ["y.txt", "x.txt"]
    assert sorted(r.n for r in files.word_totals(spark, str(tmp_path / "d")).collect()) == [1, 3]
    assert files.text_words(spark, str(tmp_path / "d" / "x.txt")).count() == 3 and files.text_words(spark, str(tmp_path / "d" / "x.txt"), by_line=True).count() == 2
    assert [r.words for r in files.html_files(spark, str(tmp_path / "d" / "x.txt")).collect()] == [["one", "two", "three"]]


def test_words(spark):
    docs = spark.createDataFrame([("a b a", "s"), (None, "s"), ("b\n c", "t")], "text string, source string")
    counts = wordcount.word_counts(docs)
    assert [tuple(r) for r in wordcount.top_words(counts, 2).collect()] == [("a", 2), ("b", 2)]
    assert sorted(map(tuple, wordcount.lookup(counts, spark.createDataFrame([("a",), ("z",)], "word string")).collect())) == [("a", 2), ("z", 0)]
    assert tuple(wordcount.token_stats(docs).first()) == (5, 5, 1.0) and wordcount.containing_all(docs, ["a", "b"]).first().n == 1
