"""Fill-in-middle, resampling and web archives against plain loops, exact round trips and SQL."""

import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import crc, infill, registry, resample, warc
from test_catalogue import rows


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(name, spark, data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{data}/{f}')")
    got, want = registry.QUERIES[name](spark, data).toPandas(), con.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_against_plain_loop(spark, awkward, empty):
    texts = ["<P", "a<S>b", "<", "<P><S>", "P>S>M>", "<<P", "a\nb\r\n🙂é", "日本 abc 1.5", "<M", "S><P"]
    more = spark.createDataFrame([(100 + i, t * k) for k in (1, 2) for i, t in enumerate(texts * 3)], "doc_id long, text string")
    for docs in (awkward.select("doc_id", "text", "h", "bucket"), more):
        made = infill.fill_in_middle(docs)
        got = [tuple(r) for r in made.withColumn("back", infill.restored(made.output, made.form)).collect()]
        have = docs.collect()
        assert sorted(map(repr, got)) == sorted(repr((r.doc_id, *plain_fim(r.doc_id, r.text), r.text or "")) for r in have)
        assert {g[2] for g in got} >= {"plain", "psm", "spm"}
    assert infill.fill_in_middle(empty).count() == 0
    with pytest.raises(ValueError):
        infill.fill_in_middle(more, sentinels=("<P>", "S", "<M>"))


def test_fill_in_middle_has_no_python(spark, data):
    plan = registry.QUERIES["op11_fim"](spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_crc_of_any_length():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 400_000, dtype=np.uint8)
    length = np.array([0, 1, 2, 3, 4, 5, 63, 64, 65, 127, 128, 129, 191, 192, 193, 1000, 4096, 5000, 70_001, 399_000, 7, 64])
    start = rng.integers(0, 1000, len(length))
    got = crc.advance(data, np.full(len(start), crc.ONES), start, length) ^ crc.ONES
    assert got.tolist() == [zlib.crc32(data[s : s + n].tobytes()) for s, n in zip(start, length, strict=True)]
    assert len(crc.advance(data, np.zeros(0, np.uint32), np.zeros(0, int), np.zeros(0, int))) == 0


TEXTS = [None, "", "one", "Ä one", "two words", "ends", "Ärger im Büro", "123 abc_DEF-9 x", "日本語のテキスト 🙂 мир", "z" * 1000 + " " + "y" * 200, "a b " * 300, "\x00a\x7fb", " ", "tail", "?!"]


def plain_runs(text, most):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return len(w), [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("most", [1, 2, 3])
@pytest.mark.parametrize("block", [1, 16, 300, 1 << 20])
def test_runs_against_plain_loop(most, block):
    texts = pa.array(["skipped", *TEXTS]).slice(1)
    found, n = [[] for _ in TEXTS], np.zeros(len(TEXTS), int)
    for lo, some, text, bucket, own in resample.bucketed(texts, 997, most, block):
        n[lo : lo + some] += own
        for t, b in zip(text, bucket, strict=True):
            found[lo + t].append(int(b))
    want = [plain_runs(t, most) for t in TEXTS]
    assert n.tolist() == [w[0] for w in want]
    assert [sorted(f) for f in found] == [sorted(zlib.crc32(r.encode()) % 997 for r in w[1]) for w in want]


def plain_resample(docs, target, most, least, percent, buckets):
    def counts(texts):
        c = [0] * buckets
        for t in texts:
            for r in plain_runs(t, most)[1]:
                c[zlib.crc32(r.encode()) % buckets] += 1
        return c

    s, t = counts(x for _, x in docs), counts(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for i, x in docs:
        n, runs = plain_runs(x, most)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(r.encode()) % buckets] for r in runs)
        out.append((i, n, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = percent * len(fit) // 100
    ranks = sorted(range(len(out)), key=lambda j: (out[j][1] < least, -out[j][4], out[j][0] is None, out[j][0] or 0))
    place = {j: k + 1 for k, j in enumerate(ranks[:drawn])}
    return [(r[0], r[2], r[3], r[4], place.get(j)) for j, r in enumerate(out)]


@pytest.mark.parametrize("most", [1, 2])
def test_resample_against_plain_loop(spark, awkward, empty, most):
    docs = awkward.select("doc_id", "text", "h", "length")
    target = spark.createDataFrame([("the cat and the dog",), (None,), ("two long words",)], "text string")
    have = [(r.doc_id, r.text) for r in docs.collect()]
    got = resample.resample(docs, target, least_words=1, percent=50, most_words=most)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, plain_resample(have, [r.text for r in target.collect()], most, 1, 50, 10_000)))
    kept = resample.resample(docs, target, least_words=1, percent=100, keep=("text",)).where("rank is not null")
    assert sorted(r.text for r in kept.collect()) == sorted(t for _, t in have if plain_runs(t, 1)[0])
    assert resample.resample(empty, target).count() == 0
    assert resample.resample(docs, empty, least_words=1).count() == len(have)


def test_resample_ranks_one_hot_id(spark):
    docs = spark.range(3000).selectExpr("if(id < 1500, 7, id) as doc_id", "concat('some words ', id) as text")
    got = resample.resample(docs, docs.limit(5), least_words=1, percent=100).select("rank").toPandas()["rank"]
    assert sorted(got) == list(range(1, 3001))


def pages_of(spark):
    long, other = "<p>same</p>" * 200, "<p>Ünï</p>" * 150
    some = [(i, f"http://h/{i}", long) for i in range(40)] + [(100, None, other), (101, "http://h/a b\r\nX: y", other), (7, "http://again", long), (39, "http://last", long)]
    some += [(200, "u", None), (201, "u", ""), (202, "u", "short"), (203, "u", "short"), (None, "u", long), (None, None, "alone " * 400), (204, "u", "x" * 3_000_000), (205, "u", "a\x00b\r\n\r\nWARC/1.1\r\n" * 99)]
    return spark.createDataFrame([(*r, "clash") for r in some], "page_id long, url string, html string, offset string").repartition(3)


def test_archives_round_trip(spark, empty, tmp_path):
    pages, folder = pages_of(spark), str(tmp_path)
    index = warc.write_archives(pages, folder, file_bytes=1_000, sample_bytes=5_000)
    names = index.select("file").distinct()
    assert names.count() > 3  # files are begun anew beyond their size
    read = warc.read_archives(spark, folder, names, with_payload=True)
    got = warc.resolved(read).toPandas()
    want = pages.toPandas()
    assert len(got) == len(want) == index.count()
    largest = {h: max((i for i in g.page_id if i == i), default=None) for h, g in want.groupby("html")}
    expected = []
    for i, h in zip(want.page_id, want.html.fillna(""), strict=True):
        data, last = h.encode(), largest.get(h)
        visits = len(data) >= 1000 and last is not None and i == i and i < last
        expected.append((None if i != i else int(i), len(data), hashlib.sha1(data).hexdigest(), "revisit" if visits else "response", int(last) if visits else None, h))
    found = [(None if i != i else int(i), int(n), d, t, None if r is None or r != r else int(r), bytes(p).decode()) for i, n, d, t, r, p in zip(got.page_id, got.payload_bytes, got.payload_digest, got.record_type, got.refers_to, got.payload, strict=True)]
    assert sorted(map(repr, found)) == sorted(map(repr, expected))
    assert {u for u in got.url if u and "X:" in u} == {"http://h/a%20b%0D%0AX:%20y"}
    for r in index.collect()[::5]:  # each record stands alone
        headers, _ = warc.read_record(folder, r.file, r.offset, r.length)
        assert headers["warc-record-id"] == r.record_id and headers["warc-type"] == r.record_type
    nothing = warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert nothing.count() == 0 and warc.read_archives(spark, folder, nothing.select("file").distinct()).count() == 0


def test_dictionary_leads_and_pays(spark, data, tmp_path):
    import zstandard

    pages = spark.read.parquet(f"{data}/pages.parquet").coalesce(1)
    index = warc.write_archives(pages, str(tmp_path)).toPandas()
    for f in set(index.file):
        raw = (tmp_path / f).read_bytes()
        size = int.from_bytes(raw[4:8], "little")
        assert raw[:4] == warc.DICTIONARY_FRAME and raw[8:12] == (0xEC30A437).to_bytes(4, "little")
        assert raw[8 + size : 12 + size] == zstandard.FRAME_HEADER
    single = sum(len(zstandard.compress(r.html.encode())) for r in pages.collect())
    assert index.length.sum() < 0.8 * single


def test_archive_of_another_payload_is_refused(tmp_path):
    name, record = warc.page_record("1", "u", b"payload", "k", None)
    w = warc.ArchiveWriter(str(tmp_path), [])
    w.add(record.replace(b"payload", b"another")[:])
    w.close()
    (_, _), (headers, block) = list(warc.read_archive(str(tmp_path), w.name))
    with pytest.raises(ValueError, match="digest"):
        warc._page(headers, block)


def test_media_of_any_number_of_frames(spark, data):
    from corpusloom.llm import media

    docs = spark.createDataFrame([(1, "some words " * 20_000), (2, "short")], "doc_id long, text string")
    stored = media.encode_text_media(docs)
    assert {r.doc_id: r.frames is None for r in media.decode_media(stored, all_pixels=70_000).collect()} == {1: True, 2: False}
    whole = {r.doc_id: b"".join(bytes(f.samples) for f in r.frames) for r in media.decode_media(stored, all_pixels=None).collect()}
    assert whole[1].rstrip(b"\0") == b"some words " * 20_000


def test_language_stage_reads_behind_long_prefixes(spark, data):
    from corpusloom.llm import langid

    rng = random.Random(6)
    noise = lambda: " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=rng.randrange(3, 9))) for _ in range(200))
    docs = spark.createDataFrame([(i, "7 " * 3000 + noise()) for i in range(10)], "doc_id long, text string")
    model = langid.train(spark.read.parquet(f"{data}/documents.parquet"))
    plain = docs.selectExpr("doc_id", "substring(text, 6001) as text")
    kept = lambda d: {r.doc_id for r in langid.keep_identified(d, model, least=0.5).collect()}
    assert kept(docs) == kept(plain) != set(range(10))  # digits before them change nothing


def test_ids_beyond_two_bytes(spark, tmp_path):
    import json

    from corpusloom.llm import token_store, tokens

    assert tokens.vocabulary(tokens.default_path()) <= 1 << 16
    with open(tokens.default_path(), encoding="utf-8") as f:
        file = json.load(f)
    word = min(file["model"]["vocab"], key=lambda w: (w != "a", w))
    file["model"]["vocab"][word] = 70_000
    (tmp_path / "large.json").write_text(json.dumps(file))
    assert tokens.vocabulary(str(tmp_path / "large.json")) == 70_001
    manifest = token_store.write_store(spark.createDataFrame([(5, "a")], "doc_id long, text string"), str(tmp_path / "store"), str(tmp_path / "large.json"))
    assert token_store.lookup(manifest, 5).tolist() == [70_000, 0]
