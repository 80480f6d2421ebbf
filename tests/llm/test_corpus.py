"""Corpus operators against SQL, libraries and brute force on small tables."""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import _shared, byte_bpe, lang_id, line_dedup, mixing, near_dedup, pieces, queries, sharding, token_files, topk, toxicity, vector_dedup
from tests.compare import differs, tables

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, size long, component string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, copies, ties and columns with clashing names."""
    words = [f"w{i}" for i in range(60)]
    base = " ".join(words)
    near = " ".join([*words[:58], "x", "y"])
    rows = [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, " \n\t"), (7, "one two"), (8, "ONE two"), (9, base.upper()),
        (10, "é" * 10 + " " + "z" * 70_000), (11, "line one is here\nline two is there\n\nline one is here"), (None, base), (1, base),
    ]
    return spark.createDataFrame([(i, x, "en", None if i == 3 else "s", 1, "c") for i, x in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    assert differs(queries.QUERIES[name](spark, FOLDER), queries.SQL[name], tables(FOLDER)) == ""


def _shingles(text):
    blank = "".join(map(chr, (32, 9, 10, 11, 12, 13)))
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(" " if c in blank else c for c in low).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _components(ids, linked):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def _near(rows):
    sets = {i: _shingles(x) for i, x in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, _components(ids, links)


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_near_duplicates(which, request):
    frame = request.getfixturevalue(which)
    counts, root = _near([(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()])
    found = near_dedup.near_duplicates(frame).collect()
    assert len(found) == frame.count()
    for r in found:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (counts[r["doc_id"]], root[r["doc_id"]], root[r["doc_id"]] == r["doc_id"])


def test_lines(odd):
    found = {r["doc_id"]: r for r in line_dedup.dedup_lines(odd).collect()}
    assert found[11]["text"] == "line one is here\nline two is there\n" and found[11]["n_lines"] == 4
    assert found[1]["n_kept"] == 1 and found[2]["n_kept"] == 0 and found[4]["text"] is None and found[5]["text"] == ""


def _line(x):
    blank = "".join(map(chr, (32, 9, 10, 11, 12, 13)))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(blank))


def _kept_lines(rows):
    """Text and numbers of lines left of each document, by comparing all lines with each other."""
    first = {}
    for i, text in sorted(rows):
        for n, x in enumerate((text or "").split("\n")):
            if _line(x):
                first.setdefault(_line(x), (i, n))
    lines = sorted(first, key=first.get)
    sets = [{x[k : k + 10] for k in range(max(1, len(x) - 9))} for x in lines]
    links = []
    for a in range(len(lines)):
        for b in range(a + 1, len(lines)):
            small, large = sorted((len(sets[a]), len(sets[b])))
            if 100 * small >= 75 * large:
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * (small + large - common):
                    links.append((a, b))
    root = _components(range(len(lines)), links)
    stay = {first[lines[a]] for a in root.values()}
    out = {}
    for i, text in rows:
        parts = (text or "").split("\n")
        kept = [x for n, x in enumerate(parts) if not _line(x) or (i, n) in stay]
        out[i] = (None if text is None else "\n".join(kept), 0 if text is None else len(parts), 0 if text is None else len(kept))
    return out


def test_lines_against_all_pairs(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    passage = "a passage of some length that very many documents share, word by word"
    rows += [(1000 + i, f"{passage} {i % 7}\nown line number {i * 7919} of document {i}\n\n{passage}") for i in range(60)]
    rows += [(2000, None), (2001, ""), (2002, " \n\t")]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_kept"]) for r in found} == _kept_lines(rows)


def test_lines_of_one_id_with_different_texts(spark):
    rows = [(1, "first line of all\nsecond line of all"), (1, "third line of all\nfirst line of all"), (1, "third line of all\nfirst line of all")]
    found = [r["text"].split("\n") for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    distinct = [x for text in {tuple(x) for x in found} for x in text if x]
    assert len(found) == 3 and sorted(distinct) == ["first line of all", "second line of all", "third line of all"]


def test_near_duplicates_of_an_id_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(0, b), (1, a), (1, b), (7, a), (1, b), (9, c), (9, None)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(0, 0), (1, 0), (7, 0), (9, 9)}


def test_near_duplicates_with_very_many_copies(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(base)) for i in range(3000)]
    rows += [(5000 + i, " ".join([*base[:36], f"x{i}", f"y{i}"])) for i in range(300)]
    counts, root = _near([(0, rows[0][1]), *rows[3000:]])
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(found) == len(rows)
    assert all(r["component_id"] == (0 if r["doc_id"] < 5000 else root[r["doc_id"]]) for r in found)


def test_large_tables_are_salted(spark, monkeypatch):
    """The plans for tables that are not broadcast, and for keys with very many rows, give the same rows."""
    rows = [(i, " ".join(f"w{k}" for k in range(30)) + f" tail{i % 40}") for i in range(200)] + [(300 + i, f"alone {i} " * 9) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = [sorted(fn(frame).collect()) for fn in (near_dedup.near_duplicates, line_dedup.dedup_lines)]
    monkeypatch.setattr(_shared, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(_shared, "HOT", 10)
    assert [sorted(fn(frame).collect()) for fn in (near_dedup.near_duplicates, line_dedup.dedup_lines)] == wanted


def test_common_sizes():
    rng = np.random.default_rng(1)
    x, y = ([np.unique(rng.integers(0, 50, 30).astype(np.uint64)) for _ in range(n)] for n in (9, 4))
    assert (line_dedup._common(x, y) == [[len(np.intersect1d(a, b)) for b in y] for a in x]).all()
    assert (line_dedup._common(x, None) == [[len(np.intersect1d(a, b)) for b in x] for a in x]).all()


def _library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_byte_pairs(which, request):
    library = _library()
    frame = request.getfixturevalue(which).filter("doc_id is not null")
    texts = {r["doc_id"]: r["text"] or "" for r in frame.select("doc_id", "text").collect()}
    for r in byte_bpe.digests(frame).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_token_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_files.VOCABULARY)
    token_files.write(docs, str(tmp_path / "ids"))
    found = {r["doc_id"]: r for r in token_files.read(spark, str(tmp_path / "ids"), digest=True).collect()}
    start = 0
    for r in sorted(docs.select("doc_id", "text").collect(), key=lambda r: r["doc_id"]):
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        assert tuple(found[r["doc_id"]])[1:] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("values", [[7], [3, 1, 3, 2, 1], [5, 4, 4 + (1 << 40), 4, 5 + (1 << 41)], [i % 3 + ((i % 5) << 60) for i in range(99)]])
def test_groups_of_equal_values(values):
    h = np.array(values, dtype=np.uint64)
    for have, want in zip(pieces.groups(h), np.unique(h, return_index=True, return_inverse=True), strict=True):
        assert (have == want).all()


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_segments(n):
    ids = np.random.default_rng(n).integers(0, 50_000, n) * (np.arange(n) % 9 > 0)
    if n > 200:
        ids[7] = 2**32 - 1
    assert (token_files.decode_segment(token_files.encode_segment(ids)) == ids).all()
    assert (token_files.decode_segment(token_files.encode_segment(ids), first=1, last=2) == ids[128:256]).all()


def test_languages(docs, odd):
    joined = lang_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang_pred <> 'und'")
    assert joined.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.9
    assert {r["doc_id"]: r["lang_pred"] for r in lang_id.identify(odd).collect()}[5] == "und"


def _above(scores, marks):
    """Share of pairs of a marked and an unmarked row in which the marked one has the higher score, ties half."""
    high, low = scores[marks], scores[~marks]
    return ((high[:, None] > low[None, :]).mean() + 0.5 * (high[:, None] == low[None, :]).mean()) if len(high) and len(low) else None


def test_toxicity(spark, docs):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    found = toxicity.score(docs, toxicity.fit(docs, labels))
    assert found.count() == docs.count() and found.filter("score < 0 or score > 1 or predicted <> int(score >= 0.5)").isEmpty()


def test_toxicity_of_rows_that_were_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    found = toxicity.score(docs, toxicity.fit(docs, labels)).filter("held_out").join(labels.select("doc_id", "toxic"), "doc_id").toPandas()
    toxic = found["toxic"].to_numpy() == 1
    assert toxic.sum() > 20 and _above(found["score"].to_numpy(), toxic) > 0.9
    assert found["predicted"][toxic].mean() > 0.8 and found["predicted"][~toxic].mean() < 0.05


def test_labels_that_contradict_each_other(spark, docs):
    text = docs.filter("length(text) > 200").select("text").first()[0]
    more = spark.createDataFrame([(10_000 + i, text) for i in range(8)], "doc_id long, text string")
    frame = docs.select("doc_id", "text").unionByName(more)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "toxic")
    labels = labels.unionByName(spark.createDataFrame([(10_000 + i, i % 2) for i in range(8)], labels.schema))
    runs = [toxicity.score(frame, toxicity.fit(frame.repartition(n), labels.repartition(n))).orderBy("doc_id").select("doc_id", "score").collect() for n in (1, 5)]
    assert runs[0] == runs[1]


def test_shards(odd):
    rows = sharding.shard(odd).collect()
    assert len(rows) == odd.count() and all(r["law"] == "bytes" for r in rows)
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_shards_are_even(docs):
    sizes = [r["n"] for r in sharding.shard(docs).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.3 * min(sizes)


def test_shards_with_long_documents(spark):
    rows = [(i, " ".join([f"w{i}"] * (20 + i % 150)), "en", "s", 1, "c") for i in range(3000)]
    rows += [(3000 + i, f"long{i:03d} " * 4500, "en", "s", 1, "c") for i in range(20)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    conf = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        many = {r["doc_id"]: (r["shard"], r["size"]) for r in sharding.shard(frame).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    one = {r["doc_id"]: (r["shard"], r["size"]) for r in sharding.shard(frame).collect()}
    held = np.bincount([s for s, _ in many.values()], weights=[n for _, n in many.values()], minlength=8)
    assert held.max() < 1.02 * held.mean() and many == one


def test_shards_keep_groups_whole(spark):
    texts = [f"copied text number {g} " * 6 for g in range(40)]
    rows = [(i, texts[i % 40]) for i in range(4000)] + [(4000 + i, f"single {i} " * 12) for i in range(4000)] + [(9000 + i, "hot " * 30) for i in range(4000)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).join(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id")
    groups = {r["text"]: r["n"] for r in found.groupBy("text").agg(F.countDistinct("shard").alias("n")).collect()}
    assert all(groups[x] == 1 for x in texts) and 1 < groups["hot " * 30] <= 4
    sizes = [r["n"] for r in found.groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.05 * min(sizes)


def test_mixing_limits(odd):
    rows = mixing.mix(odd).collect()
    assert all(0 <= r["copies"] <= 3 for r in rows) and mixing.repeat(mixing.mix(odd)).columns == ["doc_id", "text", "lang", "source", "component"]


def test_vectors_that_take_no_part(spark):
    rows = [(0, 1, [1.0, 0.0]), (20, 1, [1.0, 0.0]), (40, 1, None), (60, 1, [float("nan"), 1.0]), (80, None, [1.0, 0.0]), (5, 1, [0.0, 0.0]), (None, 1, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    links = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_vectors(frame).collect()}
    assert links[0] == links[20] == 1 and links[40] == links[60] == links[80] == links[5] == 0
    best = topk.top_k(frame).filter("query_id = 0").orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in best] == [(20, 4096), (80, 4096), (5, 0)]


def _best(rows, k=20):
    """The best k of each query by comparing it with every row."""
    whole = [(i, np.floor(64 * np.array(v, dtype=float)).astype(np.int64)) for i, v in rows]
    out = {}
    for q, x in {(i, tuple(x)): (i, x) for i, x in whole if i % 20 == 0}.values():
        out.setdefault(q, []).extend((-int(x @ y), j) for j, y in whole if j != q)
    return {q: [(j, -s) for s, j in sorted(found)[:k]] for q, found in out.items()}


@pytest.mark.parametrize("shape", ["even", "skewed", "few values"])
def test_top_k_against_every_row(spark, monkeypatch, shape):
    monkeypatch.setattr(topk, "BLOCK", 150)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 12))
    x = {"even": x, "skewed": np.sign(x) * np.abs(x) ** 5, "few values": np.round(x) / 64}[shape]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(40, x[41].tolist()), (40, x[40].tolist()), (17, x[17].tolist()), (17, x[17].tolist())]
    found = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert found == _best(rows)


def test_postings_stop_early():
    rng = np.random.default_rng(4)
    x = np.floor(64 * np.sign(rng.standard_normal((4000, 30))) * np.abs(rng.standard_normal((4000, 30))) ** 6)
    t = pa.table({"j": pa.array([0] * 4000, pa.int32()), "vec_id": pa.array(np.arange(4000)), "q": pa.array(x.tolist())})
    index = topk.ImpactIndex(topk._build(t))
    members = index.search(x[:8], np.arange(8)[:, None] == np.arange(4000)[None, :], 20)
    for q, found in enumerate(members):
        score = x @ x[q]
        score[q] = -np.inf
        assert set(np.argsort(-score, kind="stable")[:20]) <= set(found.tolist()) and len(found) < 1000


def _group_of_near_vectors(n, size, spread, seed=5):
    """Random vectors of 64 components, the first ``size`` around one centre."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:size] = x[size] + spread * x[:size]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_vectors_of_a_dense_group(spark):
    x = _group_of_near_vectors(6000, 2000, 0.2)
    frame = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    wanted = (x @ x.T >= vector_dedup.COSINE).sum(axis=1) - 1
    assert wanted[:2000].min() > 1900
    found = {r["vec_id"]: r for r in vector_dedup.near_vectors(frame.repartition(4)).collect()}
    assert [found[i]["n_links"] for i in range(2000)] == wanted[:2000].tolist()
    assert {found[i]["component_id"] for i in range(2000)} == {0}


@pytest.mark.parametrize("fn", [near_dedup.near_duplicates, line_dedup.dedup_lines, sharding.shard, byte_bpe.digests, lang_id.identify, mixing.mix])
def test_empty_tables(odd, fn):
    assert fn(odd.limit(0)).count() == 0


def test_empty_tables_of_vectors_tokens_and_labels(spark, odd, tmp_path):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<double>")
    assert topk.top_k(none).count() == 0 and vector_dedup.near_vectors(none).count() == 0
    token_files.write(odd.limit(0), str(tmp_path / "none"))
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(odd, labels) is None and toxicity.score(odd, None).count() == odd.count()
    assert toxicity.score(odd.limit(0), None).count() == 0


CLASHES = ["size", "source_size", "target", "copies", "copy_", "score", "lang_pred", "kept_", "n_lines", "n_kept", "box_", "version", "node", "rep", "text_", "kept", "component_id"]


@pytest.mark.parametrize("name", ["language", "lines", "near_duplicates", "mix", "encode"])
def test_stages_with_clashing_columns(spark, docs, odd, name):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)[name]
    plain = docs.unionByName(odd.select("doc_id", "text", "lang", "source", F.lit(0).cast("long").alias("n_chars")))
    wide = plain.select("*", *[F.concat(F.lit(c), "doc_id").alias(c) for c in CLASHES])
    key = lambda r: (str(r["doc_id"]), str(r.asDict().get("text")))
    want = sorted(stage(spark, plain, FOLDER).collect(), key=key)
    have = stage(spark, wide, FOLDER)
    if name != "encode":
        assert have.columns == wide.columns
        rows = sorted(have.collect(), key=key)
        assert [r[c] for r in rows for c in CLASHES] == [None if r["doc_id"] is None else f"{c}{r['doc_id']}" for r in rows for c in CLASHES]
        have = have.select(*plain.columns)
    assert sorted(have.collect(), key=key) == want
    assert stage(spark, wide.limit(0), FOLDER).count() == 0


def test_very_long_texts(spark):
    """A text of three megabytes, in one line and in many, beside short ones."""
    words = " ".join(f"w{i * 7919 % 9973}" for i in range(480_000))
    many = "\n".join(words[i : i + 60] for i in range(0, len(words), 60))
    rows = [(1, words, "en", "s"), (2, many, "en", "s"), (3, words + " and more", "en", "s"), (4, "short text", "en", "t"), (5, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    root = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame).collect()}
    assert root[1] == root[3] == 1 and root[4] == 4
    lines = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame).collect()}
    assert lines[1]["n_kept"] == 1 and lines[3]["n_kept"] == 0 and lines[2]["n_lines"] == many.count("\n") + 1
    for fn in (lang_id.identify, byte_bpe.digests, sharding.shard, mixing.mix):
        assert fn(frame).count() == 5
    assert byte_bpe.digests(frame).filter("doc_id = 1").first()["decoded_sha256"] == hashlib.sha256(words.encode()).hexdigest()
    assert toxicity.score(frame, None).count() == 5


def test_every_language_is_learned(spark):
    rows = [(i, f"{chr(0x4E00 + 3 * (i % 300))} " * 40, f"l{i % 300}") for i in range(6000)]
    assert {lang for lang, _ in lang_id.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))} == {f"l{i}" for i in range(300)}


def test_pipeline_against_plain_versions(spark, docs):
    """All stages but the first, whose network has no plain version, one after another by hand."""
    import duckdb

    import corpus_pipeline

    read = dict(corpus_pipeline.STAGES)["language"](spark, docs, FOLDER).toPandas()
    rows = list(zip(read["doc_id"].tolist(), read["text"].tolist(), strict=True))
    lines = _kept_lines(rows)
    texts = {i: new for i, (new, n, kept) in lines.items() if n == kept or any(_line(x) for x in new.split("\n"))}
    _, root = _near(list(texts.items()))
    left = [(i, texts[i], s) for i, s in zip(read["doc_id"].tolist(), read["source"].tolist(), strict=True) if i in texts and root.get(i, i) == i]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", left)
    taken = {i: (n // size if size else 0) for i, size, n in db.execute(f"SELECT doc_id, size, taken FROM ({mixing.SQL})").fetchall()}
    library, want = _library(), []
    for i, text, _ in left:
        ids = library.encode_ordinary(text or "")
        want += [(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())] * taken[i]
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(want)


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    named = dict(corpus_pipeline.STAGES)
    assert list(named) == ["language", "lines", "near_duplicates", "mix", "encode"]
    assert named["language"](spark, docs, FOLDER).columns == docs.columns
    assert named["lines"](spark, docs, FOLDER).columns == docs.columns
    kept = named["near_duplicates"](spark, docs, FOLDER)
    _, root = _near([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert {r["doc_id"] for r in kept.collect()} == {i for i, low in root.items() if i == low}
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def _thue_morse(n, a="a", b="b"):
    x, y = a, b
    while len(x) < n:
        x, y = x + y, y + x
    return x, y


@pytest.mark.parametrize("n", [1024, 2048, 4096, 8192])
def test_words_and_lines_that_a_polynomial_hash_takes_for_equal(spark, n):
    from tokenizers import Tokenizer

    x, y = _thue_morse(n)
    rows = [(1, x), (2, y), (3, f"{x} {y}"), (4, f"{y} {x}"), (5, f"{x}\n{y}"), (6, f" {x} {y} {x}")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    library, tokens = _library(), Tokenizer.from_file(token_files.VOCABULARY)
    for r in byte_bpe.digests(frame).collect():
        text = dict(rows)[r["doc_id"]]
        assert r["ids_sha256"] == hashlib.sha256(np.array(library.encode_ordinary(text), "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    ids, at = token_files.encode_texts(pa.array([r[1] for r in rows]))
    for k, (_, text) in enumerate(rows):
        assert ids[at[k] : at[k + 1]].tolist() == tokens.encode(text, add_special_tokens=False).ids
    counts, root = _near(rows)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame).collect()} == root
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_kept"]) for r in line_dedup.dedup_lines(frame).collect()} == _kept_lines(rows)


def test_pieces_that_share_a_hash(monkeypatch):
    """With a hash of four bits for all that is longer than seven bytes, pieces are still told apart, within a batch and between batches."""
    from loomgraph.llm import _arrays

    real = _arrays.byte_hash
    r = byte_bpe.ranks(byte_bpe.VOCABULARY)
    texts = [f"some words number {i} and antidisestablishmentarianism{i % 7} again" for i in range(50)]
    library = _library()
    encode = pieces.Encoder(lambda data, start, end: byte_bpe.encode_pieces(data, start, end, r))
    few = lambda data, start, end, seed=0: np.where(end - start > 7, real(data, start, end, seed) & np.uint64(15), real(data, start, end, seed))
    monkeypatch.setattr(_arrays, "byte_hash", few)
    for part in (texts[:20], texts[20:], texts[:5]):
        ids, at = encode(pa.array(part))
        for k, text in enumerate(part):
            assert ids[at[k] : at[k + 1]].tolist() == library.encode_ordinary(text)


def test_lines_that_share_a_node(spark, docs, monkeypatch):
    """Lines whose first hash is the same are renamed by the second one."""
    real = line_dedup._describe

    def few(batches):
        for batch in real(batches):
            own = pa.array(np.abs(batch.column("node").to_numpy()) % 5)
            yield batch.set_column(batch.schema.get_field_index("node"), "node", own)

    frame = spark.createDataFrame([(i, f"line number {i * 7919} of the text\nanother line {i % 9} that repeats") for i in range(60)], "doc_id long, text string")
    want = sorted(line_dedup.dedup_lines(frame).collect())
    monkeypatch.setattr(line_dedup, "_describe", few)
    assert [(r["doc_id"], r["n_lines"]) for r in sorted(line_dedup.dedup_lines(frame).collect())] == [(r["doc_id"], r["n_lines"]) for r in want]


@pytest.mark.parametrize("width", [64, 1024, 4096])
def test_top_k_of_wide_vectors(width):
    """Sums of single precision are off by more, the wider the vectors are; no best row may be lost by that."""
    x = np.full((31, width), 7911.0)
    x[17] = np.where(np.arange(width) % 2, 7900.0, 7923.0)
    t = pa.table({"j": pa.array([0] * 31, pa.int32()), "vec_id": pa.array(np.arange(31)), "q": pa.array(x.tolist())})
    index = topk.ImpactIndex(topk._build(t))
    query = np.full((1, width), 6399.0)
    members = index.search(query, np.zeros((1, 31), bool), 1)[0]
    assert int(np.argmax(x @ query[0])) in members.tolist()
    rng = np.random.default_rng(width)
    x = np.floor(64 * rng.standard_normal((500, width)))
    t = pa.table({"j": pa.array([0] * 500, pa.int32()), "vec_id": pa.array(np.arange(500)), "q": pa.array(x.tolist())})
    index = topk.ImpactIndex(topk._build(t))
    for q, members in enumerate(index.search(x[:9], np.eye(9, 500, dtype=bool), 20)):
        score = x @ x[q]
        score[q] = -np.inf
        assert set(np.argsort(-score, kind="stable")[:20].tolist()) <= set(members.tolist())


def test_mixing_of_many_sources(spark, docs, monkeypatch):
    want = sorted(mixing.mix(docs).select("doc_id", "target", "copies").collect())
    monkeypatch.setattr(mixing, "NAME_BYTES", -1)
    assert sorted(mixing.mix(docs).select("doc_id", "target", "copies").collect()) == want


def test_shards_by_hand(spark, docs, monkeypatch):
    """Sizes, checksums and slots against plain values, also where nothing is broadcast."""
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(None, "x"), (1, None), (1, "é"), (1, "é"), (7, "")], "doc_id long, text string"))
    plain = sorted(((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in frame.collect()), key=repr)
    for few in (_shared.BROADCAST_ROWS, 0):
        monkeypatch.setattr(_shared, "BROADCAST_ROWS", few)
        rows = sharding.shard(frame).collect()
        assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == plain
        assert {r["law"] for r in rows} == {"bytes"} and {r["shard"] for r in rows} <= set(range(8)) and {r["grown_shard"] for r in rows} == {None}
        for s in range(8):
            slots = sorted(r["slot"] for r in rows if r["shard"] == s)
            assert slots == list(range(len(slots)))


@pytest.mark.parametrize("which,left", [("language", lambda i: zlib.crc32(str(i).encode()) % 4 == 2), ("toxicity", lambda i: zlib.crc32(str(i).encode()) % 5 == 0)])
def test_rows_that_are_held_out(docs, which, left):
    found = (lang_id.identify(docs) if which == "language" else toxicity.score(docs, None)).select("doc_id", "held_out").collect()
    assert len(found) == docs.count() and all(r["held_out"] == left(r["doc_id"]) for r in found)


def test_recall_of_open_pairs(spark):
    """Single pairs far from every pivot, at cosines from the threshold on: at least nine of ten are found, and nothing below it."""
    rng = np.random.default_rng(11)
    n = 2500
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((300, 64))
    y -= (y * x[:300]).sum(axis=1, keepdims=True) * x[:300]
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    cosine = rng.uniform(0.931, 0.99, 300)[:, None]
    x = np.concatenate([x, cosine * x[:300] + np.sqrt(1 - cosine**2) * y])
    frame = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    sims = (x @ x.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None, :]
    wanted = (sims >= vector_dedup.COSINE).sum(axis=1) - 1
    found = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_vectors(frame.repartition(3)).collect()}
    assert all(found[i] <= wanted[i] for i in range(len(x)))
    assert sum(found.values()) >= 0.9 * wanted.sum() and wanted.sum() >= 600


def test_vectors_that_are_repeated(spark):
    """Repeated vec_ids and columns with the names of the results."""
    rows = [(1, 7, [1.0, 0.0], 9), (1, 7, [1.0, 0.0], 9), (2, 7, [1.0, 0.01], 9), (3, 8, [1.0, 0.0], 9), (4, 7, [0.0, 1.0], 9)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, n_links int").withColumn("component_id", F.lit("x"))
    found = sorted(map(tuple, vector_dedup.near_vectors(frame).collect()))
    assert found == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True)]
    wide = spark.createDataFrame([(20, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>").withColumn("rank", F.lit("x")).withColumn("score", F.lit("y"))
    assert [tuple(r) for r in topk.top_k(wide).collect()] == [(20, 1, 1, 8192)]


def test_token_files_of_odd_rows(spark, tmp_path):
    """Null and repeated doc_ids, null, empty and very long texts, columns with the names of the results."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_files.VOCABULARY)
    long = " ".join(f"word{i * 7919 % 9973}" for i in range(60_000))
    rows = [(3, long), (None, "no id"), (1, None), (1, "one"), (1, "one"), (2, ""), (None, "no id either")]
    frame = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, start int, n_tokens string").repartition(3)
    token_files.write(frame, str(tmp_path / "ids"))
    found = sorted(token_files.read(spark, str(tmp_path / "ids"), digest=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == [None, None, 1, 1, 1, 2, 3]
    want = sorted((str(i), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, x in rows for ids in [[*library.encode(x or "", add_special_tokens=False).ids, 2]])
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in found) == want
    start = 0
    for r in found:
        assert r["start"] == start
        start += r["n_tokens"]
