"""The queries of the engine's own operators over the driver's tables, and their DuckDB equivalents.

Searches run over an index that is written once per table directory and session.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles as O
from .functions import arith, bloom, encoding, html
from .functions import text as T
from .functions import urls as U
from .operators import frontier, ranking, search, wordcount
from .operators.static_rank import static_rank
from .plans.compile import matching, matching_sets
from .plans.query import parse, ranking_leaves
from .sources import index as ix
from .streaming import crawl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_opened: dict[tuple[str, str], ix.Index] = {}

TWO, NOT, OR, PHRASE, NESTED, ONE = "thtion thing", "thtion NOT thing", "thtion OR thing", '"of the"', "(thtion OR thing) AND ther NOT ing", "thtion"
THREE = '"of the" thing'


def query(sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, in local mode only, below a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        root = tempfile.mkdtemp(prefix="loomsearch-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def opened(spark: SparkSession, sf_dir: str, kind: str = "documents") -> ix.Index:
    """The index of ``documents`` or ``pages`` in ``sf_dir``, written at the first use in a session."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}/{kind}")
    if key not in _opened:
        rows = table(spark, sf_dir, kind)
        corpus = ix.corpus_from_documents(rows) if kind == "documents" else ix.corpus_from_pages(rows)
        _opened[key] = ix.write(corpus, shared_path(spark, f"index-{kind}"))
    return _opened[key]


def joined(c: str) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


# Tokens, postings, dictionary.

@query(O.with_tokens("SELECT chunk, doc_idx, term, pos FROM postings"))
def tokens(spark, sf_dir):
    return ix.occurrences(ix.corpus_from_documents(table(spark, sf_dir, "documents"))).select("chunk", "doc_idx", "term", "pos")


@query(O.with_tokens("SELECT chunk, doc_idx, term, count(*)::BIGINT AS n, string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS positions FROM postings GROUP BY chunk, doc_idx, term"))
def postings_grouped(spark, sf_dir):
    return opened(spark, sf_dir).postings.select("chunk", "doc_idx", "term", F.size("positions").cast("bigint").alias("n"), joined("positions").alias("positions"))


@query(O.with_tokens("SELECT term, count(DISTINCT doc_idx) AS df, count(*) AS cf FROM postings GROUP BY term"))
def dictionary(spark, sf_dir):
    return opened(spark, sf_dir).dictionary.select("term", F.col("df").cast("bigint"), F.col("cf").cast("bigint"))


@query(O.with_tokens("SELECT docs.chunk, docs.doc_idx, docs.url, count(p.pos) AS n_tokens FROM docs LEFT JOIN postings p USING (chunk, doc_idx) GROUP BY ALL", O.DOCS))
def docs_stats(spark, sf_dir):
    return opened(spark, sf_dir).docs.select("chunk", "doc_idx", "url", F.col("n_tokens").cast("bigint"))


@query(O.with_tokens("SELECT count(DISTINCT term) AS n FROM postings"))
def unique_words(spark, sf_dir):
    return opened(spark, sf_dir).dictionary.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM documents")
def unique_docs(spark, sf_dir):
    return opened(spark, sf_dir).docs.agg(F.count(F.lit(1)).alias("n"))


@query(O.with_tokens("""SELECT p.chunk, p.doc_idx, p.pos, c.cf FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_idx, pos) AS nth FROM postings
    WHERE term = 'the' AND (doc_idx, pos) >= (100, 5)) p JOIN (SELECT chunk, count(*) AS cf FROM postings WHERE term = 'the' GROUP BY chunk) c USING (chunk) WHERE nth = 1"""))
def term_lookup(spark, sf_dir):
    return ix.find(opened(spark, sf_dir).postings, "the", 100, 5).select("chunk", "doc_idx", "pos", F.col("cf").cast("bigint"))


@query(O.with_tokens("SELECT doc_idx, pos FROM postings WHERE term = 'the' AND doc_idx = 541 AND pos > 3 AND pos < 200"))
def posting_range(spark, sf_dir):
    return ix.positions_between(opened(spark, sf_dir).postings, "the", 541, 3, 200)


# Boolean operators: the one-shuffle plan, and one relational operator per node.

def _match(spark, sf_dir, text):
    return matching(opened(spark, sf_dir).postings, parse(text)).select("chunk", "doc_idx")


def _sets(spark, sf_dir, text):
    return matching_sets(opened(spark, sf_dir).postings, parse(text))


_MATCHES = {
    "word": (ONE, O.has("thtion")), "and": (TWO, f"{O.has('thtion')} INTERSECT {O.has('thing')}"), "or": (OR, f"{O.has('thtion')} UNION {O.has('thing')}"),
    "not": (NOT, f"{O.has('thtion')} EXCEPT {O.has('thing')}"), "phrase": (PHRASE, O.phrase("of", "the")),
    "nested": (NESTED, f"(({O.has('thtion')} UNION {O.has('thing')}) INTERSECT {O.has('ther')}) EXCEPT (SELECT chunk, doc_idx FROM ({O.has('ing')}) z WHERE doc_idx IN (SELECT doc_idx FROM postings WHERE term = 'ther'))"),
}
for _name, (_text, _sql) in _MATCHES.items():
    for _kind, _run in (("match", _match), ("match_sets", _sets)):
        QUERIES[f"{_kind}_{_name}"] = lambda spark, sf_dir, run=_run, text=_text: run(spark, sf_dir, text)
        ORACLE_SQL[f"{_kind}_{_name}"] = O.with_tokens(_sql)


@query(O.with_tokens(f"SELECT count(*) AS matches FROM ({O.has('thtion')} INTERSECT {O.has('thing')})"))
def match_count(spark, sf_dir):
    return search.matches(opened(spark, sf_dir), TWO).agg(F.count(F.lit(1)).alias("matches"))


@query(O.with_tokens(f"SELECT doc_idx, doc_idx % 7 AS shard FROM ({O.phrase('of', 'the')} INTERSECT {O.has('thing')})"))
def match_phrase_and_word(spark, sf_dir):
    return search.matches(opened(spark, sf_dir), THREE).select("doc_idx", F.pmod("doc_idx", F.lit(7)).alias("shard"))


# Ranking.

_AND = f"{O.has('thtion')} INTERSECT {O.has('thing')}"
_AND3 = f"{O.phrase('of', 'the')} INTERSECT {O.has('thing')}"


@query(O.with_tokens("SELECT doc_idx, pos, span FROM anchors", f"m AS ({_AND})", O.spans(["thtion", "thing"])))
def nearest_distance(spark, sf_dir):
    found = matching(opened(spark, sf_dir).postings, parse(TWO))
    return found.select("doc_idx", F.inline(ranking.spans(F.col("m"), ["thtion", "thing"])))


@query(O.with_tokens("SELECT doc_idx, score FROM dyn", f"m AS ({_AND3})", O.spans(["of", "the", "thing"]), O.dynamic(3)))
def dynamic_rank(spark, sf_dir):
    found = matching(opened(spark, sf_dir).postings, parse(THREE))
    return found.select("doc_idx", ranking.dynamic_rank(F.col("m"), ["of", "the", "thing"]).cast("int").alias("score"))


@query(O.search(_AND, [["thtion", "thing"]]) + " SELECT * FROM ranked ORDER BY rank DESC, chunk, doc_idx LIMIT 32")
def search_topk(spark, sf_dir):
    return search.search(opened(spark, sf_dir), TWO)


@query(O.search(_AND3, [["of", "the"], ["thing"]]) + " SELECT * FROM ranked ORDER BY rank DESC, chunk, doc_idx LIMIT 32")
def search_phrase(spark, sf_dir):
    return search.search(opened(spark, sf_dir), THREE)


@query(O.search(O.has("thtion"), [["thtion"]]) + " SELECT * FROM ranked ORDER BY rank DESC, chunk, doc_idx LIMIT 32")
def search_single_term(spark, sf_dir):
    return search.search(opened(spark, sf_dir), ONE)


@query(O.search(_AND, [["thtion", "thing"]]) + " SELECT * FROM ranked ORDER BY rank DESC, chunk, doc_idx LIMIT 10 OFFSET 10")
def search_page2(spark, sf_dir):
    return search.page(search.search(opened(spark, sf_dir), TWO), 2)


@query(O.search(_AND, [["thtion", "thing"]]) + """, s AS (SELECT (doc_idx % 7)::INTEGER AS shard, * FROM ranked), top AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY rank DESC, chunk, doc_idx) AS nth FROM s)
    SELECT shard, doc_idx, url, rank FROM top WHERE nth <= 32""")
def shard_merge(spark, sf_dir):
    from pyspark.sql import Window

    rows = search.scored(opened(spark, sf_dir), TWO).withColumn("shard", F.pmod("doc_idx", F.lit(7)).cast("int"))
    order = Window.partitionBy("shard").orderBy(F.desc("rank"), "chunk", "doc_idx")
    top = rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= search.TOP)
    return search.merge_shards(top.select("shard", "doc_idx", "url", "rank"))


@query(O.with_tokens(f"SELECT sum(n)::BIGINT AS matches, max(0.25 * shard) AS seconds, format('Found {{:d}} matches in {{:.3f}} seconds', sum(n)::BIGINT, max(0.25 * shard)::DOUBLE) AS line FROM (SELECT doc_idx % 7 AS shard, count(*) AS n FROM ({_AND}) GROUP BY 1)").replace("max(0.25 * shard) AS", "max(0.25 * shard)::DOUBLE AS"))
def summary(spark, sf_dir):
    per = search.matches(opened(spark, sf_dir), TWO).groupBy(F.pmod("doc_idx", F.lit(7)).alias("shard")).agg(F.count(F.lit(1)).alias("matches"))
    return search.summary(per.withColumn("seconds", F.col("shard") * F.lit(0.25)))


@query(O.search(_AND, [["thtion", "thing"]]) + r""", titled AS (SELECT *, regexp_extract(regexp_replace(url, '^(https://|http://|www\.)', ''), '^[^?]*') AS title FROM ranked)
    SELECT url, title, '' AS snippet, rank, '{"url":"' || url || '","title":"' || title || '","snippet":"","rank":' || rank || '}' AS json FROM titled ORDER BY rank DESC, chunk, doc_idx LIMIT 32""")
def search_response(spark, sf_dir):
    return search.response(search.search(opened(spark, sf_dir), TWO))


@query()
def search_pages(spark, sf_dir):
    """Extracted English pages, with title and static rank in the score."""
    return search.search(opened(spark, sf_dir, "pages"), "thing", title_weight=1, static_weight=1)


@query()
def search_compat(spark, sf_dir):
    """The grammar without phrases and groups, negated terms ranked, rarest term as anchor."""
    return search.search(opened(spark, sf_dir), "thtion NOT thing whing OR thest", compat=True, anchor="rarest")


# URLs.

_PAGES_URLS = "urls AS (SELECT page_id, url FROM pages)"


@query(f"WITH {_PAGES_URLS}, {O.URL_PARTS} SELECT page_id, host, path, first_path_segment FROM url_parts")
def url_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.ranking_parts(F.col("url")).alias("p")).select("page_id", "p.*")


@query(f"WITH {_PAGES_URLS}, {O.URL_PARTS}, {O.url_scores([['example', 'en'], ['thth']])} SELECT page_id, url_score, short_path FROM url_scored")
def url_score(spark, sf_dir):
    leaves = ranking_leaves(parse('"example en" thth'))
    return ranking.with_url_scores(table(spark, sf_dir, "pages").select("page_id", "url"), leaves).select("page_id", F.col("url_score").cast("int"), "short_path")


_CHECKS = ["https://a.org/x", "ftp://a.org", "http://porn.example.com/", "https://b.example.com:8080/p/q?x=1#y", "HTTP://A.org", "no-scheme", "https://en.wikipedia.org/wiki/Word", "http://c.org?q", "www.x.com/a?b", "https://" + "l" * 243]


def _made(spark):
    return spark.createDataFrame([(k, u) for k, u in enumerate(_CHECKS)], "page_id bigint, url string")


_MADE = "(SELECT page_id, url FROM pages UNION ALL SELECT k, u FROM (VALUES " + ", ".join(f"({k}, '{u}')" for k, u in enumerate(_CHECKS)) + ") AS made(k, u))"


def _urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url").unionByName(_made(spark))


@query(rf"""SELECT page_id, url, regexp_extract(url, '://([^/]*)', 1) AS site, CASE WHEN contains(url, '://') THEN regexp_extract(url, '://([^/?#]*)', 1) ELSE 'EMPTY' END AS host,
    regexp_extract(url, '(\.[^./]*)(/[^.]*)?$', 1) AS tld, regexp_extract(regexp_replace(url, '^(https://|http://|www\.)', ''), '^[^?]*') AS clean,
    CASE WHEN contains(url, 'wikipedia') THEN url ELSE {O.low('url')} END AS canonical,
    starts_with(url, 'http') AND NOT contains(url, 'porn') AND strlen(url) <= 250 AS crawlable FROM {_MADE}""")
def url_functions(spark, sf_dir):
    u = F.col("url")
    return _urls(spark, sf_dir).select("page_id", "url", U.site(u).alias("site"), U.frontier_host(u).alias("host"), U.top_level_domain(u).alias("tld"), U.clean_url(u).alias("clean"), U.canonical(u).alias("canonical"), U.is_crawlable(u).alias("crawlable"))


@query(rf"""SELECT page_id, url, regexp_extract(url, '^([^:]*):', 1) AS service, regexp_extract(url, '^[^:]*://([^/:?#]*)', 1) AS host,
    regexp_extract(url, '^[^:]*://[^/:?#]*:([0-9]+)', 1) AS port, regexp_extract(url, '^[^:]*://[^/]*/(.*)$', 1) AS path FROM {_MADE}""")
def url_fetch_parts(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", "url", U.split_fetch(F.col("url")).alias("p")).select("page_id", "url", "p.*")


@query(rf"""WITH t AS (SELECT page_id, url, regexp_extract(url, '(\.[^./]*)(/[^.]*)?$', 1) AS tld FROM {_MADE}) SELECT page_id, url, CASE WHEN tld IN ('.gov', '.edu', '.com', '.net', '.org') THEN 2 WHEN tld IN ('.biz', '.info') THEN 1 ELSE -2 END AS domain,
    CASE WHEN strlen(url) >= 100 THEN 0 WHEN strlen(url) >= 75 THEN 1 WHEN strlen(url) >= 50 THEN 2 ELSE 3 END AS length FROM t""")
def static_rank_url_part(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", "url", U.tld_weight(F.col("url")).alias("domain"), U.length_weight(F.col("url")).alias("length"))


@query("SELECT k AS id, v AS decoded FROM (VALUES (0, 'a b+c'), (1, '100%'), (2, '/é'), (3, 'plain')) AS t(k, v)")
def percent_decoding(spark, sf_dir):
    rows = spark.createDataFrame([(0, "a%20b+c"), (1, "100%"), (2, "/%C3%A9"), (3, "plain")], "id int, s string")
    return rows.select("id", U.percent_decode(F.col("s")).alias("decoded"))


# Pages.

@query("""SELECT page_id, starts_with(regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1), 'en') AS is_english FROM pages""")
def html_is_english(spark, sf_dir):
    return html.parse_pages(table(spark, sf_dir, "pages").select("page_id", "html"), columns=("is_english",))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '<[^>]*>', '', 'g'), '[ \t\n\r]+', ' ', 'g')) AS title FROM pages""")
def html_titles(spark, sf_dir):
    return html.parse_pages(table(spark, sf_dir, "pages").select("page_id", "html"), columns=("title_words",)).select("page_id", T.join_words(F.col("title_words")).alias("title"))


@query()
def html_words(spark, sf_dir):
    return html.parse_pages(table(spark, sf_dir, "pages").select("page_id", "html"), columns=("words",)).select("page_id", F.posexplode("words").alias("at", "word"))


@query(r"""SELECT page_id, string_agg(l, ' ' ORDER BY k) AS links FROM (SELECT page_id, unnest(ls) AS l, unnest(range(len(ls))) AS k
    FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS ls FROM pages)) GROUP BY page_id""")
def html_links(spark, sf_dir):
    return html.parse_pages(table(spark, sf_dir, "pages").select("page_id", "html"), columns=("links",)).filter(F.size("links") > 0).select("page_id", F.array_join("links", " ").alias("links"))


@query()
def page_static_rank(spark, sf_dir):
    p = html.parse_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), columns=("img_count", "n_links", "n_words"))
    return p.select("page_id", static_rank(F.col("url"), F.col("img_count"), F.col("n_links"), F.col("n_words")).alias("static_rank"))


@query()
def page_index(spark, sf_dir):
    return opened(spark, sf_dir, "pages").postings.select("chunk", "term", "field", "doc_idx", joined("positions").alias("positions"))


@query()
def page_snippets(spark, sf_dir):
    return search.snippets(html.parse_pages(table(spark, sf_dir, "pages").select("url", "html"), columns=("title_words", "description")))


# Frontier.

def _links(spark, sf_dir):
    p = html.parse_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), columns=("links", "img_count", "n_words"))
    return frontier.links(p.withColumn("static_rank", static_rank(F.col("url"), F.col("img_count"), F.size("links"), F.col("n_words"))))


_LINK_SQL = rf"""l0 AS (SELECT page_id, url, unnest(ls) AS link, unnest(range(len(ls)))::INTEGER AS "at" FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS ls FROM pages)),
l1 AS (SELECT page_id, "at", link, CASE WHEN starts_with(link, '/') THEN regexp_extract(url, '^([^:]*)://', 1) || '://' || regexp_extract(url, '://([^/]*)', 1) || link ELSE link END AS full_url
    FROM l0 WHERE NOT regexp_matches(link, '^[#?]')),
l2 AS (SELECT page_id, "at", link, CASE WHEN contains(full_url, 'wikipedia') THEN full_url ELSE {O.low('full_url')} END AS url FROM l1
    WHERE starts_with(full_url, 'http') AND NOT contains(full_url, 'porn') AND strlen(full_url) <= 250),
l AS (SELECT *, CASE WHEN contains(url, '://') THEN regexp_extract(url, '://([^/?#]*)', 1) ELSE 'EMPTY' END AS host FROM l2)"""


@query(f"WITH {_LINK_SQL} SELECT page_id, \"at\", link, url, host FROM l")
def link_resolve(spark, sf_dir):
    return _links(spark, sf_dir).drop("rank")


@query(f"WITH {_LINK_SQL} SELECT DISTINCT url, host FROM l WHERE url NOT IN (SELECT url FROM pages WHERE url IS NOT NULL)")
def frontier_dedupe(spark, sf_dir):
    return frontier.fresh(_links(spark, sf_dir), table(spark, sf_dir, "pages").select("url")).select("url", "host")


@query(f"WITH {_LINK_SQL}, u AS (SELECT DISTINCT url, host FROM l), n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY url) AS nth FROM u) SELECT url, host FROM n WHERE nth <= 3")
def frontier_host_cap(spark, sf_dir):
    return frontier.cap_hosts(_links(spark, sf_dir).select("url", "host").distinct(), 3)


@query(f"WITH {_LINK_SQL}, u AS (SELECT url, max(page_id % 10) AS rank FROM l GROUP BY url) SELECT url, rank FROM u ORDER BY rank DESC, url LIMIT 100")
def frontier_topk(spark, sf_dir):
    rows = _links(spark, sf_dir).groupBy("url").agg(F.max(F.pmod("page_id", F.lit(10))).alias("rank"))
    return frontier.best(rows, 100)


@query()
def frontier_refill(spark, sf_dir):
    queue, _ = frontier.refill(_links(spark, sf_dir).groupBy("url").agg(F.max("rank").alias("rank")), 400, 100)
    return queue


@query(f"WITH {_LINK_SQL} SELECT url, host, count(*) AS rank FROM l GROUP BY url, host")
def frontier_checkpoint(spark, sf_dir):
    path = shared_path(spark, "frontier")
    frontier.save(_links(spark, sf_dir).groupBy("url", "host").agg(F.count(F.lit(1)).alias("rank")), path)
    return frontier.restore(spark, path)


# Streams.

_WINDOWS = "SELECT time_bucket(INTERVAL '10 seconds', ts) AS start, count(*) AS n FROM events GROUP BY 1"


@query(_WINDOWS)
def events_window_10s(spark, sf_dir):
    return crawl.rate(table(spark, sf_dir, "events"))


@query(_WINDOWS)
def stream_window_10s(spark, sf_dir):
    out = shared_path(spark, "windows")
    crawl.run_once(crawl.rate(crawl.read_events(spark, sf_dir)), shared_path(spark, "stream"), lambda rows, number: rows.write.mode("overwrite").parquet(out), "complete")
    return spark.read.parquet(out)


@query("SELECT DISTINCT 'https://site.example.org/' || user_id AS url FROM events")
def stream_dedupe(spark, sf_dir):
    links = crawl.read_events(spark, sf_dir).select(F.concat(F.lit("https://site.example.org/"), F.col("user_id").cast("string")).alias("url"), F.col("event_id").alias("rank"))
    out = shared_path(spark, "queue")
    crawl.dispatch(links, shared_path(spark, "stream"), out, cap=None, k=None)
    return spark.read.parquet(out).select("url")


# Words.

@query("WITH " + O.RAW + " SELECT word, count(*) AS n FROM words GROUP BY word")
def word_count(spark, sf_dir):
    return wordcount.word_counts(table(spark, sf_dir, "documents"))


@query("WITH " + O.RAW + " SELECT word, count(*) AS n FROM words GROUP BY word ORDER BY n DESC, word LIMIT 10")
def top10_words(spark, sf_dir):
    return wordcount.top_words(wordcount.word_counts(table(spark, sf_dir, "documents")))


@query("WITH " + O.RAW + " SELECT k AS word, count(word) AS n FROM (VALUES ('the'), ('of'), ('absent'), ('The')) AS w(k) LEFT JOIN words ON word = k GROUP BY k")
def word_lookup(spark, sf_dir):
    wanted = spark.createDataFrame([("the",), ("of",), ("absent",), ("The",)], "word string")
    return wordcount.lookup(wordcount.word_counts(table(spark, sf_dir, "documents")), wanted)


@query("WITH " + O.RAW + " SELECT count(*) AS tokens, sum(strlen(word))::BIGINT AS chars, sum(strlen(word))::DOUBLE / count(*) AS mean_length FROM words")
def token_stats(spark, sf_dir):
    return wordcount.token_stats(table(spark, sf_dir, "documents"))


@query("WITH " + O.RAW + ", n AS (SELECT d.source, count(w.word) AS n FROM documents d LEFT JOIN words w USING (doc_id) GROUP BY d.source) SELECT source, n, (sum(n) OVER ())::BIGINT AS total FROM n")
def words_per_source(spark, sf_dir):
    return wordcount.words_by(table(spark, sf_dir, "documents"), "source")


@query("WITH " + O.RAW + " SELECT count(*) AS n FROM (SELECT doc_id FROM words WHERE word IN ('the', 'of') GROUP BY doc_id HAVING count(DISTINCT word) = 2)")
def conjunctive_count(spark, sf_dir):
    return wordcount.containing_all(table(spark, sf_dir, "documents"), ["the", "of"])


@query(r"WITH l AS (SELECT unnest(regexp_split_to_array(text, '\r?\n')) AS word FROM documents) SELECT word, count(*) AS n FROM l WHERE trim(word) <> '' GROUP BY word")
def line_count(spark, sf_dir):
    return wordcount.word_counts(table(spark, sf_dir, "documents"), by_line=True)


@query("WITH " + O.RAW + r""" SELECT doc_id, i AS "at", word, NOT regexp_matches(word, '[^\x00-\x7F]') AS ascii FROM words""")
def ascii_words(spark, sf_dir):
    w = F.split(F.coalesce("text", F.lit("")), "[ \t\r\n]+")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(w).alias("k", "word")).filter("word <> ''")
    return rows.select("doc_id", (F.col("k") + 1).cast("bigint").alias("at"), "word", T.is_ascii(F.col("word")).alias("ascii"))


# Arithmetic, encodings, entities, Bloom filter.

def _values(rows: list[str]) -> str:
    return ", ".join("({}, '{}')".format(k, v.replace("'", "''")) for k, v in enumerate(rows))


@query(f"SELECT k AS id, v AS value FROM (VALUES {_values(O.ARITH_WANT)}) AS t(k, v)")
def arith_eval(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(O.ARITH_ROWS)), "id int, s string").select("id", arith.evaluate_column(F.col("s")).alias("value"))


@query(f"SELECT k AS id, v AS text FROM (VALUES {_values(O.ENTITY_WANT)}) AS t(k, v)")
def html_entities(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(O.ENTITY_ROWS)), "id int, s string").select("id", T.decode_entities(F.col("s")).alias("text"))


@query("SELECT doc_id, text, strlen(text)::INTEGER AS bytes, true AS valid, 2 * length(text) + 2 AS utf16_bytes FROM documents")
def utf16_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"), encoding.to_utf16(F.col("text")).alias("b"))
    return rows.select("doc_id", encoding.from_utf16(F.col("b")).alias("text"), F.octet_length("t").alias("bytes"), encoding.valid(F.col("t")).alias("valid"), F.octet_length("b").cast("bigint").alias("utf16_bytes"))


@query("SELECT a.doc_id, CASE WHEN a.text < b.text THEN -1 WHEN a.text > b.text THEN 1 ELSE 0 END AS whole, CASE WHEN substr(a.text, 1, 2) < substr(b.text, 1, 2) THEN -1 WHEN substr(a.text, 1, 2) > substr(b.text, 1, 2) THEN 1 ELSE 0 END AS two "
       "FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def utf8_compare(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")), "doc_id")
    return both.select("doc_id", encoding.compare(F.col("text"), F.col("other")).alias("whole"), encoding.compare(F.col("text"), F.col("other"), 2).alias("two"))


@query()
def bloom_membership(spark, sf_dir):
    """Every page URL probed against a filter of those with an even id; the even ones are all found."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    bits, hashes = bloom.shape(10_000, 0.01)
    words = bloom.build(pages.filter("page_id % 2 = 0"), "url", bits, hashes)
    return bloom.probe(pages.select("url").distinct(), "url", words, bits, hashes)
