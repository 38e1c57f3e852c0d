"""WARC, packing, mixing, embeddings, host rules and the pipeline."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import cases
import numpy as np
import pyarrow.parquet as pq
import pytest
from compare import DATA, same
from pyspark.sql import functions as F

import corpus_pipeline
from clickweave.llm import common
from clickweave.llm.common import Scratch, scratch_path
from clickweave.llm.embed_dedup import EmbeddingParams, link_embeddings, quantise, tile_links, tile_product
from clickweave.llm.host_rules import HostParams, host_rates, judge
from clickweave.llm.langid import LangParams, predict_langid, tfidf, train_langid
from clickweave.llm.mixing import MixParams, replicate, source_rates
from clickweave.llm.packing import PackParams, configurations, encoder, pack, pack_documents
from clickweave.llm.queries import ORACLE_SQL, QUERIES
from clickweave.llm.warc import WarcParams, deduplicate_archives, originals, page_records, parse_records, read_archives, resolve, write_archives


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(spark, f"{DATA}/sf0.001", QUERIES[name], ORACLE_SQL[name])


# --- WARC --------------------------------------------------------------------------------------------------------------

PAGES = [(0, "http://a/", "<p>x</p>"), (1, "http://b/\r\nEvil: 1", "<p>x</p>"), (2, None, None), (3, "", ""), (4, "http://c/", "WARC/1.0\r\n\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n é\U0001f600"), (5, "http://d/", "<p>x</p>"), (5, "http://d/", "<p>x</p>"), (7, "u", "y" * 1_000_000), (None, "http://e/", "<p>x</p>")]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).withColumn("record_type", F.lit(1))


def test_warc_round_trip(spark, tmp_path):
    path = str(tmp_path / "a")
    write_archives(resolve(page_records(pages(spark))), path)
    got = Counter(tuple(r) for r in originals(read_archives(spark, path, payloads=False)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    first = {}
    for i, _, h in sorted((p for p in PAGES if p[0] is not None), key=lambda p: p[0]):
        first.setdefault(h or "", i)
    expected = Counter((i, len((h or "").encode()), digest(h), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, _, h in PAGES)
    assert got == expected


def test_warc_files_are_well_formed(spark, tmp_path):
    path = str(tmp_path / "a")
    write_archives(resolve(page_records(pages(spark))), path)
    records = []
    for f in tmp_path.glob("a/*.gz"):
        data = gzip.decompress(f.read_bytes())
        at = 0
        for fields, block in parse_records([data[k : k + 7] for k in range(0, len(data), 7)]):
            assert data[at : at + 10] == b"WARC/1.0\r\n"
            at = data.index(b"\r\n\r\n", at) + 4 + len(block)
            assert data[at : at + 4] == b"\r\n\r\n"
            at += 4
            records.append((fields, bytes(block)))
        assert at == len(data)
    assert len(records) == len(PAGES)
    assert all("\n" not in f["warc-target-uri"] for f, _ in records)
    assert "evil" not in {k for f, _ in records for k in f}
    ids = {f["warc-record-id"] for f, _ in records}
    for f, block in records:
        if f["warc-type"] == "revisit":
            assert f["warc-refers-to"] in ids
            assert block.endswith(b"\r\n\r\n")


def test_archives_are_deduplicated_again(spark, tmp_path):
    plain = page_records(pages(spark)).withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast("string")).withColumn("refers_to_uri", F.lit(None).cast("string"))
    write_archives(plain, str(tmp_path / "all"))
    assert read_archives(spark, str(tmp_path / "all")).filter("record_type = 'response'").count() == len(PAGES)
    deduplicate_archives(spark, str(tmp_path / "all"), str(tmp_path / "one"))
    one = originals(read_archives(spark, str(tmp_path / "one")))
    assert {r.record_type: r["count"] for r in one.groupBy("record_type").count().collect()} == {"response": 4, "revisit": 5}
    deduplicate_archives(spark, str(tmp_path / "one"), str(tmp_path / "two"))
    two = originals(read_archives(spark, str(tmp_path / "two")))
    assert sorted(map(str, one.select("page_id", "payload_digest", "record_type", "refers_to").collect())) == sorted(map(str, two.select("page_id", "payload_digest", "record_type", "refers_to").collect()))


def test_warc_without_pages_and_with_a_shuffled_join(spark, tmp_path, monkeypatch):
    write_archives(resolve(page_records(pages(spark).limit(0))), str(tmp_path / "none"))
    assert read_archives(spark, str(tmp_path / "none")).count() == 0
    from clickweave.llm import warc

    monkeypatch.setattr(warc, "MAX_BROADCAST_ROWS", 0)
    resolved = resolve(page_records(pages(spark)))
    got = resolved.groupBy("record_type").count().collect()
    assert {r.record_type: r["count"] for r in got} == {"response": 4, "revisit": 5}
    plan = spark._jvm.PythonSQLUtils.explainString(resolved._jdf.queryExecution(), "formatted")
    by_digest = re.findall(r"Exchange\nInput \[\d+\]: (.*)\nArguments: hashpartitioning\(payload_digest", plan)
    assert len(by_digest) == 2  # the originals and the headers, and no payload among them
    assert not any(re.search(r"\bpayload#", columns) for columns in by_digest)


@pytest.mark.parametrize("most", [None, 0])
def test_records_without_an_id_are_resolved_by_any_join(spark, monkeypatch, most):
    from clickweave.llm import warc

    if most is not None:
        monkeypatch.setattr(warc, "MAX_BROADCAST_ROWS", most)
    rows = [(1, None, "u", "same", "d", 4), (2, None, "u", "same", "d", 4), (3, None, "v", "other", "e", 5), (None, None, None, "same", "d", 4), (4, "id", "u", "same", "d", 4)]
    records = spark.createDataFrame(rows, "page_id long, record_id string, uri string, payload string, payload_digest string, payload_bytes long")
    got = Counter((r.page_id, r.record_type) for r in resolve(records).collect())
    assert got == Counter([(1, "response"), (2, "revisit"), (3, "response"), (None, "revisit"), (4, "revisit")])


def test_archives_whose_records_have_no_id(spark, tmp_path):
    record = lambda page, body: f"WARC/1.0\r\nWARC-Type: response\r\nPage-ID: {page}\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()
    for name, pages_of in (("a", [(3, "xyz"), (1, "xyz")]), ("b", [(2, "xyz"), (4, "else")])):
        (tmp_path / f"{name}.gz").write_bytes(gzip.compress(b"".join(record(p, b) for p, b in pages_of)))
    records = read_archives(spark, str(tmp_path)).collect()
    assert len({r.record_id for r in records}) == 4
    deduplicate_archives(spark, str(tmp_path), str(tmp_path / "out"))
    got = {r.page_id: (r.record_type, r.refers_to) for r in originals(read_archives(spark, str(tmp_path / "out"), payloads=False)).collect()}
    assert got == {1: ("response", None), 2: ("revisit", 1), 3: ("revisit", 1), 4: ("response", None)}


def test_records_that_end_early_are_refused():
    whole = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    assert [(h["content-length"], b) for h, b in parse_records([whole, b"\r\n", whole])] == [("5", b"ab\r\nc")] * 2
    for broken in ([whole[:-7]], [b"x" + whole], [whole[:20]]):
        with pytest.raises(ValueError, match="record"):
            list(parse_records(broken))


def test_an_archive_of_large_pages_is_read_as_a_stream(spark, tmp_path):
    rows = spark.range(0, 3000, 1, 1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.col("id").cast("string"), F.repeat(F.lit("\r\n\r\nWARC/1.0 "), 7000)).alias("html"))
    write_archives(resolve(page_records(rows)), str(tmp_path / "a"), WarcParams(records_per_file=10_000))
    got = read_archives(spark, str(tmp_path / "a"), payloads=False)  # one file of 270 MB
    assert got.agg(F.count("*"), F.sum("payload_bytes"), F.countDistinct("payload_digest")).first()[:] == (3000, 3000 * 7000 * 13 + 10890, 3000)


# --- packing -----------------------------------------------------------------------------------------------------------


def test_encoder_equals_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    theirs, ours = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), encoder(None)
    for text in ["", "a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "   ok\r\n\t ", "a" * 3000, "\x00�\U0001f600" * 50, "don't  stop", cases.EDGE_TEXTS[8][1], cases.EDGE_TEXTS[12][1]]:
        assert theirs.encode(text, add_special_tokens=False).ids == ours(text)
        assert encoder(public_tokenizers.path("byte_bpe_50k.json"))(text) == ours(text)
    rng = random.Random(8)
    parts = ["a", "Ab", " ", "  ", "\n", "\t\r\n", "'s", "'LL", "é", "ß", "\u0301", "\u00a0", "\u3000", "漢字", "\U0001f600", "123", "٣", "<|endoftext|>", "<|end", "!!", "#", "_", "\x00", "\u200d", "don't", "x" * 40]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        assert theirs.encode(text, add_special_tokens=False).ids == ours(text)


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_valid_and_tight(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.lognormal(6, 1.2, 4000).astype(int) + 1, 2048)
    sequence, offset = pack(lengths, PackParams())
    ends = defaultdict(list)
    for s, o, n in zip(sequence.tolist(), offset.tolist(), lengths.tolist(), strict=True):
        ends[s].append((o, n))
    for rows in ends.values():
        at = 0
        for o, n in sorted(rows):
            assert o == at
            at += n
        assert at <= 2048
    assert len(ends) <= math.ceil(lengths.sum() / 2048) + 2


@pytest.mark.parametrize("part", [1.0, 0.6, 0.3])
def test_packing_takes_about_the_fewest_sequences(part):
    """Lengths of the table: at most one sequence above the number that no packing can go below."""
    encode, rng = encoder(None), np.random.default_rng(7)
    docs = pq.read_table(f"{DATA}/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    lengths = [n for text in docs for all_ in [len(encode(text or "")) + 1] for n in [all_ % 2048 or 2048] + [2048] * ((all_ - 1) // 2048)]
    lengths = np.array(lengths)[rng.random(len(lengths)) < part]
    sequence, _ = pack(lengths, PackParams())
    assert len(set(sequence.tolist())) <= math.ceil(lengths.sum() / 2048) + 1


def test_packing_of_few_pieces():
    for lengths in ([], [1], [2048], [2047, 1], [1500, 1500, 548, 548], [700] * 7):
        sequence, _ = pack(np.array(lengths, np.int64), PackParams())
        best = {0: 0, 1: 1, 2: 1 if lengths != [2048] else 1, 4: 2, 7: 4}[len(lengths)]
        assert len(set(sequence.tolist())) == best


def test_configurations_meet_the_demand():
    sizes, demand = np.array([1000, 700, 400]), np.array([10.0, 20.0, 30.0])
    used = configurations(sizes, demand, 2048)
    assert all((c * sizes).sum() <= 2048 for c, _ in used)
    assert np.allclose(sum(c * t for c, t in used), demand)
    assert sum(t for _, t in used) < (demand * sizes).sum() / 2048 * 1.15


def test_packed_documents(spark):
    df = cases.docs(spark)
    got = pack_documents(df, PackParams(block_pieces=50)).collect()
    encode = encoder(None)
    expected = Counter()
    for i, text, _ in cases.EDGE_TEXTS:
        ids = np.array([*encode(text or ""), 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        expected.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in rows) <= 2048 and [o for o, _ in sorted(rows)] == list(np.cumsum([0] + [n for _, n in sorted(rows)])[:-1]) for rows in by.values())
    assert pack_documents(cases.empty(spark)).count() == 0


# --- mixing --------------------------------------------------------------------------------------------------------------


def poisson_count(rate, u):
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u and k < 1000:
        k += 1
        p *= rate / k
        total += p
    return k


def test_replication_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "source").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    weights = spark.createDataFrame([("hot", 1.0), ("src1", 5.0), ("src2", 0.0)], "source string, weight double")
    params = MixParams(epochs=3.0)
    rates = {r.source: r.rate for r in source_rates(docs, params, weights).collect()}
    counts = Counter(r.doc_id for r in replicate(docs, params, weights).collect())
    expected = Counter()
    for r in docs.collect():
        u = int(hashlib.md5(f"{params.seed}:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        if (n := poisson_count(rates.get(r.source, 0.0), u)) > 0:
            expected[r.doc_id] = n
    assert counts == expected
    shares = Counter(r.source for r in replicate(docs, params, weights).collect())
    assert set(shares) == {"hot", "src1"}
    assert 3.5 < shares["src1"] / shares["hot"] < 7


def test_mixing_is_shuffled_and_keeps_columns(spark):
    docs = cases.docs(spark)
    out = replicate(docs, MixParams(epochs=50.0), names=("the_copy", "the_order"))
    assert out.columns == [*docs.columns, "the_copy", "the_order"]
    order = [r.the_order for r in out.collect()]
    assert order == sorted(order)
    assert replicate(cases.empty(spark)).count() == 0
    twice = Counter(r.doc_id for r in replicate(docs.filter("doc_id = 9"), MixParams(epochs=20.0)).collect())
    assert twice[9] % 2 == 0


def test_large_rates_do_not_underflow(spark):
    docs = spark.createDataFrame([(k, "s") for k in range(50)], "doc_id long, source string")
    n = replicate(docs, MixParams(epochs=1000.0)).count()
    assert abs(n - 50_000) < 1500


# --- embeddings ----------------------------------------------------------------------------------------------------------


def brute_links(rows, threshold):
    usable = [(i, label, np.array(v, float)) for i, v, label in rows if label is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    links, parent = Counter(), {r[0]: r[0] for r in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, la, x) in enumerate(usable):
        for j, lb, y in usable[:a]:
            if la == lb and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[i] += 1
                links[j] += 1
                p, q = top(i), top(j)
                parent[max(p, q)] = min(p, q)
    return {i: (links[i], top(i), top(i) == i) for i, _, _ in rows}


@pytest.mark.parametrize("tile", [7, 1024])
def test_embeddings_equal_brute_force(spark, tile):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 16))
    rows = []
    for k in range(150):
        v = centres[k % 6] + rng.normal(size=16) * rng.choice([0.0, 0.02, 0.08, 0.12])
        rows.append((k * 2, [float(x) for x in v.astype(np.float32)], int(k % 3 > 0)))
    rows += [(1, None, 0), (3, [0.0] * 16, 0), (5, [float("nan")] + [1.0] * 15, 0), (7, [None] + [1.0] * 15, 0), (9, [1.0] * 16, None), (11, [1.0, 2.0], 0), (13, [], 0), (15, [1e-30] * 16, 0), (17, [3e30] * 16, 0), (19, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("digest", F.lit("clash")).withColumn("node", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in link_embeddings(df, EmbeddingParams(tile=tile, strip_bytes=320 if tile == 7 else 1 << 20)).collect()}
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert got == brute_links(exact, 0.98)


def test_repeated_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in link_embeddings(df).collect()) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert link_embeddings(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (None, [0.0, 1.0], 1), (None, [0.0, 1.0], 1), (3, [1.0, 0.1], 1)], "vec_id long, embedding array<double>, label int")
    got = sorted((str(r.vec_id), r.n_links, r.component_id) for r in link_embeddings(nulls).collect())
    assert got == [("1", 3, 1), ("2", 3, 1), ("3", 3, 1), ("None", 1, None), ("None", 1, None), ("None", 3, 1)]


def test_quantisation_bound_is_rigorous():
    rng = np.random.default_rng(3)
    for size in (3, 64, 1500):
        x = rng.normal(size=(200, size)) * rng.lognormal(0, 2, (200, size))
        x /= np.linalg.norm(x, axis=1)[:, None]
        q, s, e = quantise(x)
        near = tile_product(q, q) * s[:, None] * s[None, :]
        assert (np.abs(near - x @ x.T) <= e[:, None] + e[None, :] * (1 + e[:, None]) + 1e-12).all()
        assert (tile_product(q, q) == q.astype(np.int64) @ q.astype(np.int64).T).all()
    a, b = tile_links(x[:50], x[:50], 0.98, True)
    assert len(a) == len(b) == 0


# --- host rules ----------------------------------------------------------------------------------------------------------


def brute_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + d for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for d in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


TEXTS = ["a b c d e f g h i j k", "a b c d e " * 3, "x " * 40, "one\ntwo\none\n\n \n \none", "#*$%&|<> é ünï \U0001f600 " * 4, "a b c d e z a b c d e " + " ".join(map(str, range(60))), "w", "a b c d e a b c d e"]


def test_statistics_equal_brute_force(spark):
    import random

    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice(["a ", "b ", "c\n", "dd\t", "#", "é "]) for _ in range(rng.randrange(200))) for _ in range(200)]
    df = spark.createDataFrame([(k, t, "h") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in judge(df, F.col("source")).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_stats(texts[r.doc_id])


def test_hosts_are_shrunk(spark):
    good, bad = " ".join(map(str, range(20))), "x"
    rows = [(k, bad if k < 90 else good, "bad") for k in range(100)] + [(k, good if k % 20 else bad, "good") for k in range(100, 400)] + [(400, bad, "tiny")] + [(401, good, "tiny2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = judge(df, F.col("source")).collect()
    rates = {r.doc_id: r.host_rate for r in got}
    assert rates[0] > 0.8
    assert rates[101] < 0.1
    assert 0.25 < rates[400] < 0.9
    kept = {r.doc_id for r in got if r.kept}
    assert 95 not in kept  # a good document of a bad host
    assert 101 in kept
    assert 401 in kept
    stats = spark.createDataFrame([("a", True)] * 3, "host string, base_failed boolean")
    assert host_rates(stats).first().rate == 1.0


def planted_hosts():
    """Hosts with some failures in some documents: name, documents, failures."""
    good, bad = " ".join(map(str, range(20))), "x"
    hosts = [("most", 400, 20), ("bad", 60, 45), ("small", 4, 3), ("one", 1, 1), ("half", 30, 15), ("some", 100, 24), ("none", 50, 0)]
    rows = [(bad if k < failures else good, host) for host, n, failures in hosts for k in range(n)]
    return hosts, [(k, t, h) for k, (t, h) in enumerate(rows)]


def rejected_hosts(hosts, strengths):
    """The verdicts by hand."""
    n, f = sum(h[1] for h in hosts), sum(h[2] for h in hosts)
    m = f / n
    v = (sum(h[2] ** 2 / h[1] for h in hosts) - n * m * m - m * (1 - m) * (len(hosts) - 1)) / n
    s = min(strengths[1], max(strengths[0], m * (1 - m) / v - 1)) if v > 0 else strengths[1]
    out = set()
    for host, k, failures in hosts:
        rate = (failures + m * s) / (k + s)
        bound = rate - 2.33 * math.sqrt(rate * (1 - rate) / (k + s + 1))
        out |= {host} if bound > max(3 * m, 0.2) else set()
    return out


@pytest.mark.parametrize("strengths", [(1.0, 1.0), (20.0, 20.0), (1000.0, 1000.0), (1.0, 1000.0)])
def test_host_verdicts_equal_brute_force_for_every_strength(spark, strengths):
    hosts, rows = planted_hosts()
    got = judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), F.col("source"), HostParams(strengths=strengths)).collect()
    expected = rejected_hosts(hosts, strengths)
    assert {rows[r.doc_id][2] for r in got if r.host_rejected} == expected
    assert {r.doc_id for r in got if r.kept} == {k for k, t, h in rows if t != "x" and h not in expected}


def test_the_prior_decides(spark):
    hosts, _ = planted_hosts()
    by = {s: rejected_hosts(hosts, (s, s)) for s in (1.0, 20.0, 1000.0)}
    assert by[1.0] == {"bad"} and by[1000.0] == set()
    assert "small" not in rejected_hosts(hosts, (1.0, 1000.0))  # three of four failed, which is little evidence


def test_planted_hosts_equal_sql(spark, tmp_path):
    _, rows = planted_hosts()
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/made")
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    (tmp_path / "made").rename(tmp_path.parent / f"{tmp_path.name}-made")
    same(spark, str(tmp_path), QUERIES["op9_host_rules"], ORACLE_SQL["op9_host_rules"])
    got = QUERIES["op9_host_rules"](spark, str(tmp_path)).filter("NOT base_failed AND NOT kept")
    assert {rows[r.doc_id][2] for r in got.collect()} == {"bad"}  # the host's sound documents fail with it


def test_no_host_of_the_tables_is_rejected(spark):
    """Their hosts differ by chance alone."""
    got = QUERIES["op9_host_rules"](spark, f"{DATA}/sf0.01")
    assert got.filter("kept = base_failed").count() == 0


def test_salted_verdicts_are_the_same(spark, monkeypatch):
    from clickweave.llm import host_rules

    df = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    first = sorted(map(str, judge(df, F.col("source")).collect()))
    monkeypatch.setattr(host_rules, "MAX_BROADCAST_ROWS", 0)
    assert first == sorted(map(str, judge(df, F.col("source"), HostParams(salts=3)).collect()))


def test_host_edges_and_plan(spark):
    out = judge(cases.docs(spark), F.col("source"))
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(cases.EDGE_TEXTS)
    assert got[1].n_words == got[2].n_words == got[3].n_words == 0
    assert got[1].base_failed
    assert got[6].n_words == 150_000
    assert got[6].n_repeat_words == 150_000
    assert judge(cases.empty(spark), F.col("source")).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan


# --- the pipeline ----------------------------------------------------------------------------------------------------------


def test_stages_on_edges(spark):
    docs, kept = cases.docs(spark), Scratch(spark)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "secrets", "mixture", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = kept.save(stage(spark, docs, ""), name)
        if name != "packing":
            assert out.columns == docs.columns
        assert stage(spark, cases.empty(spark), "").count() == 0
        docs = out if name != "packing" else docs
    single = corpus_pipeline.near_duplicates(spark, cases.docs(spark), "")
    ids = [r.doc_id for r in single.select("doc_id").collect()]
    assert sorted(map(str, ids)) == sorted(map(str, [0, 1, 2, 3, 4, 6, 8, 9, None, 10]))


def test_pipeline_equals_brute_force(spark):
    from test_jaccard import brute
    from test_secrets import brute as spans

    sf = f"{DATA}/sf0.001"
    docs, kept = common.table(spark, sf, "documents"), Scratch(spark)
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        outs[name] = kept.save(stage(spark, docs, sf), f"stage-{name}")
        if name == "near_duplicates":
            expected = brute([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
            assert sorted(r.doc_id for r in outs[name].collect()) == sorted(i for i, (_, c, _) in expected.items() if c == i)
        if name == "secrets":
            assert sorted(r.doc_id for r in outs[name].collect()) == sorted(r.doc_id for r in docs.collect())
            assert all(spans(r.text)[1] == "" for r in outs[name].collect())
            assert all(len(r.text) == r.n_chars for r in outs[name].collect())
        docs = outs[name]
    assert outs["language"].count() >= 0.99 * common.table(spark, sf, "documents").count()
    shares = Counter(r.source for r in outs["mixture"].collect())
    assert shares["src1"] > 1.5 * shares["src0"]
    pieces = outs["packing"].groupBy("doc_id").agg(F.countDistinct("piece").alias("n"), F.count("*").alias("rows")).collect()
    copies = Counter(r.doc_id for r in outs["mixture"].collect())
    assert all(r.rows == r.n * copies[r.doc_id] for r in pieces)
    assert {r.doc_id for r in pieces} == set(copies)
    assert corpus_pipeline.run(spark, sf).count() == outs["packing"].count()


OTHER_TEXTS = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    "xq zzkw 93!! vvbn @@ qqq ##kkk wxyz jjjj qzx vkq zxcv qwrt pgh",
    "for (int i=0;i<n;++i){ a[i]=b[i]*c[i]; } return 0;",
    "12345 67890 !!!",
    "",
    None,
]


def test_language_stage_drops_unlearned_text_only(spark):
    docs = common.table(spark, f"{DATA}/sf0.01", "documents").select("doc_id", "text", "lang", "source", "n_chars")
    other = spark.createDataFrame([(-1 - k, t, None, "x", 0) for k, t in enumerate(OTHER_TEXTS)], cases.DOCS)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(other), "").select("doc_id").collect()}
    clean = {r.doc_id for r in docs.select("doc_id").collect()}
    assert not {i for i in kept if i < 0}
    assert kept >= clean
    model = train_langid(docs)
    assert model.familiar > 0.2
    got = {r.doc_id: r for r in predict_langid(docs.unionByName(other), model).collect()}
    for r in [*docs.limit(200).collect(), *other.collect()]:  # once more, text by text
        if r.text and any(c.isalpha() for c in r.text):
            idx, val = tfidf(r.text, model.idf, LangParams())
            share = sum(float(v) ** 2 for i, v in zip(idx, val, strict=True) if model.weights[i].any())
            assert got[r.doc_id].is_familiar == (share >= model.familiar * (1 - 3 / math.sqrt(len(idx))))


def test_near_duplicates_compares_rows_and_not_ids(spark):
    text = lambda name, n=60: " ".join(f"{name}{k}" for k in range(n))
    rows = [(1, text("a")), (5, text("b")), (5, text("c")), (5, text("a") + " more"), (7, text("c") + " more"), (7, text("d")), (None, text("e")), (None, text("e")), (None, text("e") + " more"), (None, text("b") + " more"), (None, text("f")), (8, " "), (8, " "), (9, " ")]
    df = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], cases.DOCS)
    got = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert got == sorted((str(i), t) for i, t in [(1, text("a")), (5, text("b")), (5, text("c")), (7, text("d")), (None, text("e")), (None, text("f")), (8, " "), (9, " ")])


def test_scratch_is_in_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
