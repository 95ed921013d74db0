"""Each operator against a brute-force version, and its defined cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomsearch.llm import bpe, exact_dedup, graph, language_id, minhash, mixing, pretoken, secrets, token_files, url_rules, vector_dedup, warc
from loomsearch.llm.queries import QUERIES, RULES, TOKENIZER_FILE

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, **more):
    """Documents with two more columns whose names operators use inside."""
    rows = [(k, t, more.get("lang", ["en"] * len(texts))[k], more.get("source", ["s"] * len(texts))[k], len(t or ""), k, "x") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS + ", digest bigint, salt string")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# 1

HEX40 = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
SECRETS = [
    f'x token = "{HEX40}" y', "Password:abcdefghijkl", "password: short", "AKIA" + "A1" * 7, "AKIA" + "A1" * 6 + "B", "akia" + "A1" * 9, "0123456789abcde", "g0123456789abcdefg", "", None,
    "é日 secret='aaaa.bbbb-cccc'", "api_key  =  ABCDEFGHIJKL; API-KEY=ABCDEFGHIJKL", "token=token=abcdefghijklm", "passwd" + " " * 5000 + "=", "AKIAAKIA" + "Z" * 30]


def brute_spans(text):
    out = []
    for kind, pattern, group, least in (("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)):
        out += [(kind, *m.span()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_secret_spans(spark):
    found = by_id(secrets.find_secrets(docs(spark, SECRETS)))
    for k, t in enumerate(SECRETS):
        base, spans = ([(s.kind, s.start, s.end) for s in x] for x in (found[k].base, found[k].spans))
        assert base == brute_spans(t or "") and set(base) <= set(spans)
    assert secrets.find_secrets(docs(spark, [])).count() == 0


def brute_cost(value, cost):
    best = [0.0]
    for i in range(1, len(value) + 1):
        best.append(min(best[j] + cost(value[j:i]) for j in range(i)))
    return best[-1]


def test_guess_cost():
    for cheap in ("password123", "qwertyuiop1", "aaaaaaaaaaaa1", "abcabcabcabc1", "1990-12-31", "changeme2024", "correcthorse1", "P4ssw0rd2020"):
        assert secrets.guess_bits(cheap) < secrets.MIN_BITS, cheap
        assert not secrets.is_secret(cheap)
    for dear in ("x7Kp2mQ9vL", "tr0ub4dor&3xZ!9", "9f8e7d6c5b4aKz"):
        assert secrets.is_secret(dear), dear
    # No better than brute force over single characters, and never below the best cut into known words and brute force.
    for v in ("zx81kk", "hello9world", "ab12ab12"):
        assert secrets.guess_bits(v) <= sum(map(secrets._char_bits, v)) + secrets.SEGMENT_BITS + 1e-9
    bits = lambda s: secrets.SEGMENT_BITS + (np.log2(secrets.RANK[s] + 1) if s in secrets.RANK else sum(map(secrets._char_bits, s)))
    assert secrets.guess_bits("secretvzpk") == pytest.approx(brute_cost("secretvzpk", bits))


def test_guess_spans_in_context():
    text = "my pwd is x7Kp2mQ9vL. And passphrase: correcthorse1; bearer = ${TOKEN1234567}"
    _, spans = secrets.scan(text)
    assert [text[s:e] for k, s, e in spans if k == "guess"] == ["x7Kp2mQ9vL"]
    assert secrets.scan("pwd=" + "a1B2" * 50_000)[1] == []  # however long, a repeat is cheap
    rng = random.Random(1)
    long = "".join(rng.choices("ghijkXYZ01", k=100_000))
    assert secrets.scan(f"pwd={long}")[1] == [("guess", 4, 100_004)]


# 2

def test_quota_tree():
    rng = random.Random(3)
    for shards in (1, 2, 5, 16):
        quotas = [rng.randint(0, 500) for _ in range(7)] + [0, 4000]
        leaves = mixing.split_quotas(quotas, shards)
        assert [sum(x) for x in zip(*leaves, strict=True)] == quotas
        sizes = list(map(sum, leaves))
        assert max(sizes) - min(sizes) <= max(1, shards.bit_length())
        assert leaves == mixing.split_quotas(quotas, shards)


def test_hypergeometric_moments():
    rng = random.Random(1)
    good, bad, draws = 300, 700, 200
    x = [mixing._hypergeometric(rng, good, bad, draws) for _ in range(3000)]
    assert abs(np.mean(x) - 60) < 0.6 and abs(np.var(x) - 200 * 0.3 * 0.7 * 800 / 999) < 4
    assert mixing._hypergeometric(rng, 5, 0, 3) == 3 and mixing._hypergeometric(rng, 0, 9, 4) == 0


MIX = ["a b c", "a b c", None, "", "x " * 3000, "q r", "long " * 2500, " one\ttwo\n", "p"]
SOURCES = ["b", "b", "b", "é", None, "a", "c", "c", "a"]


def test_mix(spark):
    rows = docs(spark, MIX, source=SOURCES)
    rows = rows.unionByName(rows.filter("doc_id in (0, 5)"))
    parts = mixing.mix(rows, block_words=100, shards=4)
    got = mixing.taken_words(*parts).collect()
    assert len(got) == 11 and all(0 <= r.taken <= 3 * r["size"] for r in got)
    sizes = {None: 3000, "a": 5, "b": 9, "c": 2502, "é": 0}
    assert sum(sizes.values()) == sum(r["size"] for r in got)
    targets = {r.source: r for r in parts[1].collect()}
    assert {s: t.source_size for s, t in targets.items()} == sizes
    for s, t in targets.items():
        assert t.target <= 3 * sizes[s] + 1e-6
        assert sum(r.words for r in parts[2].collect() if r.source == s) == pytest.approx(t.target, abs=1)
    assert sum(t.target for t in targets.values()) == pytest.approx(sum(sizes.values()))
    blocks = parts[2].collect()
    assert len({(r.doc_id, r.copy_of, r.epoch, r.block) for r in blocks}) == len(blocks)
    per = [sum(r.shard == j for r in blocks) for j in range(4)]
    assert max(per) - min(per) <= 2
    again = mixing.taken_words(*mixing.mix(rows, block_words=100, shards=4)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    empty = mixing.mix(rows.filter("false"))
    assert mixing.taken_words(*empty).count() == 0


def test_mix_documents(spark):
    rows = docs(spark, ["w " * 10] * 40 + ["v " * 10] * 5, source=["a"] * 40 + ["b"] * 5)
    out = mixing.mix_documents(rows, shards=2)
    assert out.columns == rows.columns
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert n == {"a": 30, "b": 15} and out.filter("source = 'b'").groupBy("doc_id").count().agg(F.max("count")).first()[0] == 3


# 3

def test_phrases_like_brute_force():
    passages = {"x": ["the cat sat on the mat", "a dog ran"], "y": ["der hund lief", "die katze sass"]}
    model = language_id.Model(passages)
    texts = ["the dog sat", "die katze lief auf der mat", "zzz", "the the the, a!", "1 2 3"]
    cost, letters = model.phrases(texts)
    for i, t in enumerate(texts):
        squeezed = re.sub(r"[^a-z]+", "_", t)
        for k, lang in enumerate(model.langs):
            sources = [re.sub(r"[^a-z]+", "_", p) for p in passages[lang]]
            n, at, known = 0, 0, set("".join("".join(v) for v in passages.values()))
            while at < len(squeezed):
                size = 1
                while at + size < len(squeezed) and any(squeezed[at:at + size + 1] in s for s in sources):
                    size += 1
                if not any(squeezed[at:at + size] in s for s in sources) and size > 1:
                    size = 1
                n, at = n + 1, at + size
            assert abs(cost[i, k] - n) <= 1, (t, lang, known)  # one for how the first phrase counts
    assert letters.tolist()[-1] == 0


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op3_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_language_cases(spark):
    rows = docs(spark, ["the cat and the dog", None, "", "123 !?", "der hund und die katze", "x" * 100_000], lang=["en", "en", None, "en", "de", None])
    model = {"en": ["the cat and the dog sat"], "de": ["der hund und die katze"]}
    got = by_id(language_id.predict(rows, model))
    assert [got[k].lang_pred for k in range(5)] == ["en", "und", "und", "und", "de"] and got[5].lang_pred in ("de", "en")
    kept = language_id.keep_known(rows, model)
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == [0, 4, 5]
    assert {r.lang_pred for r in language_id.predict(rows, {}).collect()} == {"und"}
    assert language_id.sample(rows.filter("false"), F.lit(True)) == {} and set(language_id.sample(rows, F.lit(True))) == {"en", "de"}


# 4, 7

ALPHABET = " '  stmdrevl  \n\t.!a1é日²' Ⅷ\u3000"


def random_texts(n=120, seed=2):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return [*texts, "", "a" * 3000, " " * 3000, "日本語テキスト漢字" * 200, "Hello, world! <|endoftext|> it's we'll", "x\u0000y", "abc" * 40, "two words " * 90_000]


def test_split_like_regex():
    import regex

    texts = random_texts(600)
    pieces, counts = pretoken.split(texts)
    pieces, at = pieces.to_pylist(), 0
    for t, n in zip(texts, counts, strict=True):
        assert pieces[at:at + n] == regex.findall(public_tokenizers.PATTERN, t)
        at += n
    assert pretoken.split(["", ""])[1].tolist() == [0, 0]


def test_bpe_like_tiktoken(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = [*random_texts(), None]
    got = by_id(bpe.digests(docs(spark, texts), path))
    long = by_id(bpe.encode_decode(docs(spark, texts), path))
    for k, t in enumerate(texts):
        ids = reference.encode_ordinary(t or "")
        assert got[k].n_tokens == len(ids) and long[k].ids == ids and bytes(long[k].decoded) == (t or "").encode()
        assert got[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(docs(spark, []), path).count() == 0


def test_token_files(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER_FILE)
    texts = [*random_texts(60), None, "hi <|endoftext|> yo", "<|endoftext|>", "x<|endoftext|><|endoftext|>y <|endoftex", "one two three " * 60_000]
    files = token_files.write(docs(spark, texts), TOKENIZER_FILE, length=64, rows=4)
    got = by_id(token_files.spans(spark, files))
    start, stream = 0, []
    for k, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        stream += ids
    at = 0
    for name, total, _ in files:
        one = token_files.SequenceFile(name)
        for i in range(-(-total // 64)):
            tokens, mask = one.sequence(i)
            have = min(64, total - 64 * i)
            assert len(tokens) == 64 and tokens[:have].tolist() == stream[at:at + have] and np.unpackbits(mask, bitorder="little").tolist() == [1] * have + [0] * (64 - have)
            at += have
    assert token_files.spans(spark, token_files.write(docs(spark, []), TOKENIZER_FILE)).count() == 0


# 5

def brute_vectors(rows):
    ids, links = [r[0] for r in rows], {k: set() for k in range(len(rows))}
    ok = lambda v, lab: v is not None and lab is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows[:i]):
            if ok(a, la) and ok(b, lb) and la == lb and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[i].add(j)
                    links[j].add(i)
    out = {}
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[ids[i]] = (len(links[i]), min(ids[j] for j in seen))
    return out


def test_vectors(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 90))):
            rows.append([len(rows), (centre + rng.normal(0, rng.choice([0.05, 0.2]), 16)).astype(np.float32).tolist(), c % 2])
    for extra in ([0.0] * 16, [float("nan")] * 16, None, [], [None] * 16, [1.0] * 8, [1.0] * 8, [-0.0, 1.0], [0.0, 1.0]):
        rows.append([len(rows), extra, 0])
    rows += [[len(rows) + k, rows[0][1], lab] for k, lab in enumerate((0, 0, 1, None))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("m", F.lit(1))
    got = by_id(vector_dedup.assign(df), "vec_id")
    want = brute_vectors(rows)
    assert {k: (r.n_links, r.component_id) for k, r in got.items()} == want and all(r.kept == (k == r.component_id) for k, r in got.items())
    assert vector_dedup.assign(df.filter("false")).count() == 0


# 6

def brute_rule(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest).group()
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw), re.match(r"[^?#]*", rest[len(raw):]).group()
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[2:]) if fits else (host, path, None, "allow")


def test_url_rules(spark):
    rng = random.Random(8)
    labels, paths = ["net", "org", "example", "com", "a", "B", "xnet", ""], ["", "/", "/en/", "/en/x", "/de/y?z", "/fr/", "?q", "#f/en/"]
    urls = [f"http{rng.choice('s ').strip()}://" + ".".join(rng.choices(labels, k=rng.randint(1, 4))) + rng.choice(paths) for _ in range(400)] + [None, "", "no scheme", "x://", "https://net", "https://net/"] + ["https://a.example.net/en/hot"] * 300
    rules = [*RULES, ("block", "a.example.net", "/en/x"), ("allow", "com", "/"), ("block", "example.net", "/en/x")]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id bigint, url string, rule string")
    for chosen in (RULES, rules):
        got = by_id(url_rules.apply_rules(pages, chosen), "page_id")
        assert len(got) == len(urls)
        for k, u in enumerate(urls):
            assert tuple(got[k])[1:] == brute_rule(u, chosen), u
    assert url_rules.apply_rules(pages.filter("false"), RULES).count() == 0


# 8

PAGES = [(1, "http://a/", "<p>x"), (2, "http://b/", "<p>y"), (3, None, "<p>x"), (4, "http://d/\r\nX: y", "é\r\n\r\nWARC/1.1\r\n"), (5, "u", ""), (6, "v", None), (None, "w", "<p>x"), (None, "w", "only"), (7, "z", "<p>x" * 30_000)]


def test_warc(spark):
    pages = spark.createDataFrame([(*p, 0) for p in PAGES], "page_id bigint, url string, html string, digest int")
    path = warc.archive(pages)
    rows = warc.read(spark, path).collect()
    assert len(rows) == len(PAGES)
    by = {r.page_id: r for r in rows if r.page_id is not None}
    assert (by[1].record_type, by[1].refers_to, by[3].record_type, by[5].refers_to, by[6].record_type) == ("revisit", 3, "response", 6, "response")
    for p, _, h in PAGES:
        if p is not None:
            raw = (h or "").encode()
            assert by[p].payload_bytes == len(raw) and by[p].payload_digest == warc.digest32(raw)
            assert by[p].payload is None if by[p].record_type == "revisit" else bytes(by[p].payload) == raw
    nulls = {r.refers_to: r.record_type for r in rows if r.page_id is None}
    assert nulls == {3: "revisit", None: "response"}
    heads = warc.read(spark, path, payload=False)
    assert heads.filter("payload is not null").count() == 0 and heads.filter("record_type = 'revisit'").count() == 3
    assert [r.page_id for r in warc.read(spark, path).filter("page_id = 4").collect()] == [4]
    plan = warc.read(spark, path).filter("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan  # the reader does it
    empty = warc.archive(pages.filter("false"))
    assert warc.read(spark, empty).count() == 0


def test_headers_first():
    """A record that isn't wanted is never read beyond its headers."""
    import io

    class Counting(io.BytesIO):
        got = 0

        def read(self, n=-1):
            out = super().read(n)
            self.got += len(out)
            return out

    stream = Counting(warc.make_record(1, "u", b"x" * 100_000, None) + warc.make_record(2, "u", b"y" * 10, None))
    rows = list(warc.read_records(stream, lambda r: r["page_id"] == 2))
    assert [r["payload"] for r in rows] == [b"y" * 10] and stream.got < 1000


# 9

def test_exact(spark):
    texts = ["a", "b", "a", None, "", "c", "a", "B"]
    rows = docs(spark, texts)
    rows = rows.unionByName(rows.filter("doc_id = 6")).unionByName(spark.createDataFrame([(None, "c", "en", "s", 1, 1, "x"), (None, "n", "en", "s", 1, 1, "x")], rows.schema))
    got = exact_dedup.assign(rows).collect()
    assert len(got) == rows.count()
    want = {"a": (6, 4), "b": (1, 1), "": (4, 2), "c": (5, 2), "B": (7, 1), "n": (None, 1)}
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in want}
    assert all((r.keep_id, r.group_size) == want[sha[r.text_sha256]] for r in got)
    kept = [r for r in got if r.kept]
    assert sorted(sha[r.text_sha256] for r in kept) == sorted(want) and all(r.doc_id == r.keep_id for r in kept)
    stay = exact_dedup.keep_first(rows)
    assert stay.columns == rows.columns and sorted((r.text or "") for r in stay.collect()) == sorted(want)
    assert exact_dedup.assign(rows.filter("false")).count() == 0 and exact_dedup.keep_first(rows.filter("false")).count() == 0


def test_exact_batches(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    one, two = docs(spark, ["a", "b", "b"]), docs(spark, ["c", "a", "b", "c"]).withColumn("doc_id", F.col("doc_id") + 10)
    exact_dedup.assign(one, index).collect()
    got = by_id(exact_dedup.assign(two, index))
    assert {k: (r.keep_id, r.group_size, r.kept) for k, r in got.items()} == {10: (13, 2, False), 11: (0, 2, False), 12: (2, 3, False), 13: (13, 2, True)}
    assert index.table().count() == 3
    again = exact_dedup.keep_first(two, index)
    assert again.count() == 0
    groups = exact_dedup.cut(exact_dedup.classes(exact_dedup.fold(two)), "groups")
    plan = index.fresh(groups)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1  # of the batch's digests; the index isn't shuffled
    index.drop()
    assert not index.exists()


def test_exact_query_through_the_index(spark, monkeypatch, tmp_path):
    """op9 works in two batches, the second one anti-joined, keeps nothing in the catalogue, and a hot text is never joined row by row."""
    plans = []
    fresh = exact_dedup.DigestIndex.fresh

    def watched(self, groups):
        out = fresh(self, groups)
        plans.append(out._jdf.queryExecution().toString().split("== Physical Plan ==")[1])
        return out

    monkeypatch.setattr(exact_dedup.DigestIndex, "fresh", watched)
    rows = docs(spark, ["hot"] * 300 + [f"t{k % 90}" for k in range(200)])
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    before = {t.name for t in spark.catalog.listTables()}
    got = by_id(QUERIES["op9_exact_dedup"](spark, str(tmp_path)))
    assert len(plans) == 1 and "LeftAnti" in plans[0] and "HashAggregate" not in plans[0]
    assert {t.name for t in spark.catalog.listTables()} == before
    assert len(got) == 500 and all((r.keep_id, r.group_size, r.kept) == (299, 300, k == 299) for k, r in got.items() if k < 300)
    assert all(got[k].keep_id == max(m for m in range(300, 500) if (m - 300) % 90 == (k - 300) % 90) for k in range(300, 500))


# 10

def brute_near(texts, percent=85):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in enumerate(sets)}


def near_texts():
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = [None, "", "  \n", "one two", "One  TWO", "one two three", "É é", "é é"]
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randint(5, 200))
        for _ in range(rng.randint(1, 14)):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
        texts += [" ".join(base)] * rng.randint(0, 3)
    chain = rng.choices(vocabulary, k=200)
    for k in range(12):  # each is near the next only
        texts.append(" ".join(chain[:]))
        chain = chain[6:] + rng.choices(vocabulary, k=6)
    rng.shuffle(texts)
    return texts


def test_near(spark):
    texts = near_texts()
    got = by_id(minhash.assign(docs(spark, texts)))
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == brute_near(texts)
    assert all(r.kept == (k == r.component_id) for k, r in got.items())
    assert minhash.assign(docs(spark, [])).count() == 0


def test_near_later_rounds(spark):
    """Nodes of one bucket in several components are open, and each open bucket has a centre."""
    sig = lambda k, other=0: np.array([k] * 110 + [other] * 10, np.uint32).tobytes()
    sigs = spark.createDataFrame([(k, bytearray(sig(k // 5, k))) for k in range(20)], "node bigint, sig binary")
    members = spark.createDataFrame([(7, k) for k in range(10)] + [(8, k) for k in range(10, 13)], "key bigint, node bigint")
    comp = spark.createDataFrame([(k, 0) for k in range(4)] + [(10, 10), (11, 10), (12, 10)], "node bigint, component bigint")
    open_ = minhash._mixed(members, comp)
    assert sorted({(r.key, r["size"]) for r in open_.collect()}) == [(7, 10)] and open_.count() == 10
    pairs = [tuple(r) for r in minhash._central(open_, sigs).collect()]
    assert len({a for a, _ in pairs}) == 1 and len(pairs) == 9


def test_near_prefix_join(spark, monkeypatch):
    """Every pair across components that is similar enough comes, whatever the sizes, the order of shingles and the blocks; a family of one size without links gives none."""
    rng = random.Random(17)
    sets = []
    for _ in range(12):
        base = rng.sample(range(100_000), rng.randint(1, 160))
        for _ in range(rng.randint(1, 12)):
            kept = [x for x in base if rng.random() > rng.choice((0.0, 0.03, 0.1, 0.2))]
            sets.append(kept + rng.sample(range(100_000), rng.randint(0, len(base) // 8)) or [1])
    comp = [rng.randrange(20) for _ in sets]
    rows = spark.createDataFrame([(k, comp[k], sorted(set(s))) for k, s in enumerate(sets)], "node bigint, component bigint, shingles array<bigint>")
    same = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    for percent in (80, 85):
        want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if comp[i] != comp[j] and 100 * same(sets[i], sets[j]) >= percent}
        for common, rare, block in ((100_000, 64, 256), (1000, 2, 3)):
            monkeypatch.setattr(minhash, "COMMON", common)
            monkeypatch.setattr(minhash, "RARE", rare)
            monkeypatch.setattr(minhash, "BLOCK", block)
            got = {tuple(r) for r in minhash._across(rows, percent).collect()}
            assert want and want <= got
    base = list(range(1000, 1100))
    family = [(k, k, sorted(base[:3 * (k % 30)] + base[3 * (k % 30) + 5:] + [10**6 + 5 * k + i for i in range(5)])) for k in range(300)]
    loose = minhash._across(spark.createDataFrame(family, "node bigint, component bigint, shingles array<bigint>"), 95)
    assert loose.count() == 0


def test_near_family(spark):
    """Copies of a text with one to eight edits: the text's component is found from its centre, heavy edits stay out."""
    rng = random.Random(3)
    base = [f"b{k}" for k in range(146)]
    texts = [" ".join(base)]
    for k in range(120):
        words = list(base)
        for _ in range(1 + k % 8):
            words[rng.randrange(len(words))] = f"e{k}x{rng.randrange(9)}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    got = by_id(minhash.assign(docs(spark, texts)))
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == brute_near(texts)


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2060)]
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: find(k) for k in list(parent) if k not in loops}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_skew_join(spark, monkeypatch):
    monkeypatch.setattr(graph, "LEAST_HEAVY", 5)
    rows = spark.createDataFrame([(k % 3 if k < 40 else k, k) for k in range(60)], "key bigint, v bigint")
    keyed = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("most"))
    got = graph.skew_join(rows, keyed, "key", 60).collect()
    assert len(got) == 60 and all(r.most >= r.v for r in got)
