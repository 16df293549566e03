"""Null, empty, repeated and very long rows, empty tables, and clashing columns, for every operator and stage."""

import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cloakframe.llm import chat, common, fastbpe, langid, mixing, packing, quality, secret_scan, setjoin, simhash, spotsigs, tokenbin, toxicity
from cloakframe.llm.components import connected_components
from cloakframe.llm.fastbpe import Encoder
from cloakframe.llm.simhash import trie_pairs

LONG = "the quick brown fox and a dog of the house in this land " * 4000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["size", "Target", "Spans", "Score", "rejected", "kept", "fp", "_key", "_part", "_text", "_index", "slice", "guest", "signatures", "component_id", "words", "_n", "_last", "_found", "_old_spans", "_row", "_epoch", "row", "_passes"]
ROWS = [
    (1, "password = hunter2hunter2 the fox", "en", "a", 33),
    (1, "password = hunter2hunter2 the fox", "en", "a", 33),
    (2, None, None, None, None),
    (None, "", "en", "a", 0),
    (None, None, None, "b", None),
    (3, " \n\t ", "en", None, 4),
    (4, LONG, "en", "b", len(LONG)),
    (5, LONG, "en", "b", len(LONG)),
    (6, "12345 !!!", None, "c", 9),
    (7, "naïve café 😀 über", "fr", "c", 18),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def wide(docs):
    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(EXTRA)])


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def test_mixing(docs, empty, wide):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(ROWS)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert {r["doc_id"]: r["size"] for r in got}[2] == 0 and {r["source"]: r["source_size"] for r in got}[None] == 0
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    out = mixing.mix_sources(wide)
    assert out.count() == len(ROWS) and [c for c in out.columns if c == "_key"] == ["_key"]
    own = mixing.mixed_documents(wide)
    assert own.columns == wide.columns and {(r["size"], r["_epoch"]) for r in own.collect()} == {(0, EXTRA.index("_epoch"))}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert sum(len((r["text"] or "").split()) for r in mixed.collect()) == sum(r["taken"] for r in got)


def test_quality(docs, empty, wide):
    got = quality.judge(docs).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got if r["doc_id"]}
    assert by[2]["n_words"] == 0 and by[2]["base_failed"] and not by[2]["kept"]
    assert by[4]["n_repeat_words"] == by[4]["n_words"] == 52000 and not by[4]["kept"]
    assert quality.judge(empty).count() == 0 and quality.judge(wide).count() == len(ROWS)


def test_divergence_numbers(spark):
    t = spark.createDataFrame([([1, 1, 0], [0, 0, 5]), ([2, 2], [3, 3]), ([0, 0], [1, 1]), ([1, 3], [3, 1])], "p array<long>, q array<long>")
    got = [r[0] for r in t.select(quality.js_distance("p", "q")).collect()]
    p, q = np.array([0.25, 0.75]), np.array([0.75, 0.25])
    m = (p + q) / 2
    want = np.sqrt((np.sum(p * np.log2(p / m)) + np.sum(q * np.log2(q / m))) / 2)
    assert got[:2] == pytest.approx([1.0, 0.0]) and got[2] is None and got[3] == pytest.approx(want)


def test_simhash(docs, empty, wide):
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got[1, 1] == 2 and got[5, 4] == got[4, 4] == 1
    assert got[2, 2] == got[3, 2] == 1 and got[None, 2] == 2
    assert simhash.near_duplicates(empty).count() == 0 and simhash.near_duplicates(wide).count() == len(ROWS)
    first = simhash.deduplicated(wide)
    assert first.columns == wide.columns and sorted(r["doc_id"] for r in first.collect()) == [1, 2, 4, 6, 7]


def test_rows_without_ids_are_kept(spark):
    rows = [(None, "one two three four"), (None, "one two three four"), (None, "other words are here"), (5, "five six seven eight"), (None, "five six seven eight")]
    out = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, out.collect())) == Counter([(5, "five six seven eight"), (None, "one two three four"), (None, "other words are here")])


@pytest.mark.parametrize("options", [{}, {"shingle": 5, "likeness": (4, 5)}])
def test_repeated_ids_keep_a_row_of_each_component(spark, options):
    a, b, c = "one two three four five six", "the fox and the dog of the house", "zebra words are quite unlike all others"
    rows = [(1, a), (2, c), (2, b), (2, c), (1, b), (3, c)]
    out = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), **options)
    assert Counter(map(tuple, out.collect())) == Counter([(1, a), (1, b), (2, c)])


def plain_components(sets):
    """key -> least key of its component, links being Jaccard indexes of 0.8 or more; by brute force."""
    root = {k: k for k in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0]
    while any(root[a] != root[b] for a, b in links):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_pipeline_drops_near_copies(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {}
    for r in table.collect():
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = set(zip(*(w[i:] for i in range(5)), strict=False)) or ({tuple(w)} if w else set())
    root = plain_components(sets)
    got = [r["doc_id"] for r in corpus_pipeline.deduplicate(spark, table, "").select("doc_id").collect()]
    assert sorted(got) == sorted(k for k, r in root.items() if k == r) and len(got) == 922


@pytest.mark.parametrize("frequent", [2, 10**6])
def test_set_join_is_exact(spark, monkeypatch, frequent):
    monkeypatch.setattr(setjoin, "FREQUENT", frequent)
    monkeypatch.setattr(setjoin, "MANY", frequent)
    rng, sets = np.random.default_rng(11), {}
    for _ in range(60):
        base = set(map(int, rng.choice(150, rng.integers(1, 60), replace=False)))
        for _ in range(rng.integers(1, 7)):
            drop = set(map(int, rng.choice(sorted(base), rng.integers(0, max(1, len(base) // 6)), replace=False)))
            sets[len(sets)] = base - drop | set(map(int, rng.integers(0, 150, rng.integers(0, 3))))
    t = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "key long, members array<long>")
    root = plain_components(sets)
    want = {k: r for k, r in root.items() if sum(x == r for x in root.values()) > 1}
    order = setjoin.member_order(t.select(F.explode("members").alias("member")))
    prefixes = t.where("size(members) > 0").select(F.explode(setjoin.first_members_column("members", order)).alias("member"), "key", F.size("members").alias("n"), *setjoin.bitmap_columns("members"))
    plain = {k: sorted(map(int, setjoin.first_members(np.array(sorted(v)), np.array(order)))) for k, v in sets.items() if v}
    assert {r["key"]: sorted(r["p"]) for r in prefixes.groupBy("key").agg(F.collect_list("member").alias("p")).collect()} == plain
    for seed in (None, spark.createDataFrame([(0, 1), (5, 90)], "u long, v long")):
        got = setjoin.similar_components(prefixes, lambda keys: t.join(keys, "key", "left_semi"), seed=seed)
        assert {r["node"]: r["root"] for r in got.collect()} == want


def test_bitmaps_differ_no_more_than_sets(spark):
    rng, rows = np.random.default_rng(12), []
    for k in range(120):
        base = np.unique(rng.integers(-(2**63), 2**63 - 1, int(rng.integers(0, 400))))
        other = np.unique(np.concatenate([base[rng.random(len(base)) < 0.8], rng.integers(-(2**63), 2**63 - 1, int(rng.integers(0, 60)))]))
        rows += [(k, 0, base.tolist()), (k, 1, other.tolist())]
    t = spark.createDataFrame(rows, "pair long, side int, members array<long>").select("pair", "side", "members", F.array(*setjoin.bitmap_columns("members")).alias("bits"))
    found = {(r["pair"], r["side"]): r for r in t.collect()}
    for k in range(120):
        a, b = found[k, 0], found[k, 1]
        assert a["bits"] == setjoin.bitmap(np.array(a["members"], dtype=np.int64)) and b["bits"] == setjoin.bitmap(np.array(b["members"], dtype=np.int64))
        differ = sum(((x ^ y) % (1 << 64)).bit_count() for x, y in zip(a["bits"], b["bits"], strict=True))
        assert differ <= len(set(a["members"]) ^ set(b["members"]))


@pytest.mark.parametrize("kept", [1, 2, 3])
def test_blocks_find_every_link(spark, kept):
    rng = np.random.default_rng(kept)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    fps = set(map(int, base))
    for f in base:
        for _ in range(rng.integers(0, 5)):
            fps.add(int(f) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)))
    fps = sorted(fps)
    want = {frozenset((a, b)) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3}
    found = set()
    for mask in simhash.block_masks(3, kept):
        key = sorted(fps, key=lambda f: (f & mask % 2**64, f))
        arr = np.array(key, dtype=np.uint64)
        masked = arr & np.uint64(mask % 2**64)
        starts = np.r_[np.flatnonzero(np.r_[True, masked[1:] != masked[:-1]]), len(arr)]
        for a, b in trie_pairs(arr, starts, 3, frontier=50):
            found |= {frozenset((int(arr[x]), int(arr[y]))) for x, y in zip(a, b, strict=True)}
    assert found == want


def test_hot_groups_are_dealt_again(spark):
    rng = np.random.default_rng(9)
    base = int(rng.integers(0, 2**62))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 9), replace=False)) for _ in range(300)})
    root = {f: f for f in fps}
    for _ in fps:
        for a in fps:
            root[a] = min(root[b] for b in fps if (a ^ b).bit_count() <= 3)
    want = {f: r for f, r in root.items() if sum(x == r for x in root.values()) > 1}
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    for hot in (5, 10**6):
        assert {r["node"]: r["root"] for r in simhash.link_fingerprints(table, hot=hot).collect()} == want
    assert simhash.deal(table, 3, 1, 5).groupBy("block", "bits").count().agg(F.max("count")).first()[0] < simhash.deal(table, 3, 1).groupBy("block", "bits").count().agg(F.max("count")).first()[0]


def test_heavy_keys_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 4)
    left = spark.createDataFrame([(1, i) for i in range(20)] + [(k, k) for k in range(2, 12)] + [(None, 0)], "k long, a long")
    right = spark.createDataFrame([(k, -k) for k in range(1, 10)], "k long, b long")
    want = Counter(map(tuple, left.join(right, "k").select("k", "a", "b").collect()))
    assert Counter(map(tuple, common.join_unique(left, right, "k").select("k", "a", "b").collect())) == want


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(i, i + 1) for i in range(200, 260)] + [(int(a), int(b)) for a, b in rng.integers(0, 150, (90, 2))] + [(300, 300)]
    root = {n: n for p in pairs for n in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {n: r for n, r in root.items() if n in got} and set(root) - set(got) == {n for n in root if not any(n in p and p[0] != p[1] for p in pairs)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_languages(docs, empty, wide):
    model = langid.fit_languages(docs)
    got = langid.identify_languages(wide, model).collect()
    assert [r["lang_pred"] for r in got] == ["en", "en", "und", "und", "und", "und", "en", "en", "und", "fr"]
    assert all(r["rejected"] and r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert langid.identify_languages(empty, langid.fit_languages(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.identify_languages(docs, langid.fit_languages(empty)).collect()} == {"und"}


def test_number_signs_are_no_letters(spark):
    model = langid.fit(["the house of the fox", "la casa de la zorra"], ["en", "es"])
    assert [p[0] for p in model.predict(["½ ² ³", "Ⅷ", "12 !", "Ⅷ fox"])] == ["und", "und", "und", "en"]
    rows = [(None, f"text number {i} of the fox and house", "en") for i in range(3000)]
    assert len(langid.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=200).languages) > 0


def test_nearest_centroid_by_brute_force(spark, sf_dir):
    """What the operator gives is the centroid with the greatest cosine, worked out one text and one gram at a time."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit_languages(table)
    for r in langid.identify_languages(table.where("doc_id % 9 = 0"), model).collect():
        letters = "".join(c if c.isalpha() else " " for c in (r["text"] or "").lower())
        b = (" " + " ".join(letters.split()) + " ").encode()
        if not b.strip():
            assert r["lang_pred"] == "und"
            continue
        tf = Counter()
        for n in (1, 2, 3):
            for i in range(len(b) - n + 1):
                tf[((int.from_bytes(b[i : i + n], "big") + (n << 28)) * 2654435761) % 2**32 >> 19] += 1
        v = np.zeros(langid.DIMENSIONS)
        for k, x in tf.items():
            v[k] = np.log1p(x) * model.idf[k]
        cosines = model.centroids @ (v / np.linalg.norm(v))
        assert model.languages[int(cosines.argmax())] == r["lang_pred"] and r["score"] == pytest.approx(float(cosines.max()), abs=1e-4)


def test_far_texts_are_rejected(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit_languages(table)
    assert model.predict(["Съешь ещё этих мягких французских булок да выпей чаю " * 5])[0][2]
    assert len(model.languages) > len(set(model.languages))


UNLEARNED = {
    "Finnish": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "Turkish": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
    "Dutch": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten.",
    "Italian": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza.",
    "gibberish": "xqzv kjwp qqxz vbnm zxcv qwrt plkj hgfd wxyz jkqv zzxq bvcx mnqw rtyp sdfg hjkl qzxw vcbn",
    "letters": " ".join("".join(chr(97 + (7 * i * i + 11 * i * j + j**3) % 26) for j in range(3 + i % 6)) for i in range(60)),
}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_unlearned_languages_are_rejected(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    model = langid.fit_languages(table)
    assert {k: r for k, (_, _, r) in zip(UNLEARNED, model.predict(list(UNLEARNED.values())), strict=True)} == dict.fromkeys(UNLEARNED, True)
    found = [r["rejected"] for r in langid.identify_languages(table.where("doc_id % 5 = 0"), model).select("rejected").collect()]
    assert sum(found) < 0.005 * len(found)


def test_token_records(spark, docs, empty, wide, paths, tmp_path):
    folder = f"file://{tmp_path}/records"
    shards = tokenbin.write_token_records(wide, folder, paths[0], parts=3)
    got = tokenbin.read_token_records(spark, folder, shards, with_ids=True).collect()
    by_start = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in by_start] == [0, 0, 1, 1, 2, 3, 4, 5, 6, 7] or [r["doc_id"] for r in by_start] == [None, None, 1, 1, 2, 3, 4, 5, 6, 7]
    assert [r["n_tokens"] for r in by_start][:2] == [1, 1] and all(r["ids"][-1] == 2 for r in got)
    i, ids = tokenbin.read_payload(folder, shards[-1]["shard"], shards[-1]["n_docs"] - 1)
    assert i == 7 and list(ids) == by_start[-1]["ids"]
    assert tokenbin.write_token_records(empty, f"{folder}2", paths[0]) == []
    with pytest.raises(Exception, match="fit the width"):
        tokenbin.write_token_records(docs, f"{folder}3", paths[0], width=1)
    assert tokenbin.read_token_records(spark, folder, []).count() == 0


def test_damaged_records():
    record = tokenbin.frame(b"payload")
    assert tokenbin.unframe(record + record, len(record)) == (b"payload", 2 * len(record))
    for bad in (record[:-1], b"\1" + record[1:], record[:13] + b"x" + record[14:], record[:5]):
        with pytest.raises(tokenbin.CorruptRecord):
            tokenbin.unframe(bad)


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_encoder_is_the_library(paths, kind):
    from tokenizers import Tokenizer

    path = paths[kind == "word"]
    plain, own = Tokenizer.from_file(path), Encoder(path, kind)
    rng = np.random.default_rng(1)
    parts = ["a", "B", "é", "'", "’", " ", "  ", "\n", "\r", "\t", "'s", "'LL", "ß", "İ", "ı", "ŉ", "ǅ", "0", "²", "½", ".", "<|endoftext|>", "<|startoftext|>", "😀", "\x85", "\xa0", "\x1c", "é", "中", "word"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(600)] + [None, LONG]
    assert [list(x) for x in own.encode_all(texts, chars=2000)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_spotsigs(docs, empty, wide):
    got = spotsigs.edited_neighbours(wide).collect()
    assert len(got) == len(ROWS) and sorted(r["doc_id"] or 0 for r in got) == [0, 0, 1, 1, 2, 3, 4, 5, 6, 7]
    by = {r["doc_id"]: r for r in got}
    assert by[4]["fingerprint"] == by[5]["fingerprint"] != "" and by[4]["near_next"] == 1.0
    assert by[2]["fingerprint"] == "" and by[2]["n_chars"] == 0 and by[2]["near_edited"] == 1.0
    assert by[7]["edited_sha256"] == hashlib.sha256(ROWS[9][1][:9].encode()).hexdigest()  # the first row's text is null
    assert spotsigs.edited_neighbours(empty).count() == 0
    assert spotsigs.edited_neighbours(docs.where("doc_id = 7")).first()["near_next"] == 1.0


def test_deduplicated_hands_few_texts_to_python_at_once(spark, monkeypatch):
    sets, most = simhash._sets, simhash.BATCH

    def watched(*options):
        run = sets(*options)

        def checked(batches):
            for batch in batches:
                assert batch.num_rows <= most
                yield from run([batch])

        return checked

    monkeypatch.setattr(simhash, "_sets", watched)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    table = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.floor(F.col("id") / 2) + i for i in (1, 7, 5, 3, 9, 4)]).alias("text"))
    assert sorted(r["doc_id"] for r in simhash.deduplicated(table, 5, (4, 5)).collect()) == list(range(0, 3000, 2))
    assert spark.conf.get(name) == before


def test_workers_keep_nothing_of_another_operator(paths):
    encode = fastbpe.encoder(paths[1], "word").encode
    encode("the fox")
    common.occupies("packing")
    kept = fastbpe.encoder(paths[1], "word")
    kept.encode("the fox")
    common.occupies("packing")
    assert fastbpe.encoder(paths[1], "word") is kept and kept.known
    texts = pa.RecordBatch.from_pydict({"doc_id": [1], "row": [1], "text": ["the fox and a dog"]})
    assert next(simhash._fingerprints(3)([texts])).num_rows == 1
    assert not fastbpe._encoders


def test_fitted_languages_leave_no_free_memory(docs, monkeypatch):
    done, fitted = [], langid.fit
    monkeypatch.setattr(langid, "fit", lambda *a, **b: (done.append("fitted"), fitted(*a, **b))[1])
    monkeypatch.setattr(langid, "give_back", lambda: done.append("given back"))
    langid.fit_languages(docs)
    assert done == ["fitted", "given back"]


def test_fit_holds_one_table_of_counts():
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "klmnprst"]
    texts = [" ".join(words[(i * k) % 200] for k in range(1, 30)) for i in range(1600)]
    tracemalloc.start()
    langid.fit(texts, [f"l{i % 8}" for i in range(1600)])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2 * 1600 * langid.DIMENSIONS * 4


def test_packing_hands_few_texts_to_python_at_once(spark, monkeypatch, paths):
    pack = packing._pack

    def watched(*options):
        run = pack(*options)

        def checked(batches):
            def each():
                for batch in batches:
                    assert batch.num_rows <= 500
                    yield batch

            return run(each())

        return checked

    monkeypatch.setattr(packing, "_pack", watched)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    table = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("the fox").alias("text"))
    assert packing.pack_documents(table, paths[1]).count() == 3000
    assert spark.conf.get(name) == before


def test_secrets_start_no_python(spark):
    index = secret_scan.trigram_index(spark.range(3).select(F.col("id").alias("key"), F.lit("password = hunter2hunter2").alias("text")))
    found = secret_scan.candidates(index)
    assert "ExistingRDD" not in found._jdf.queryExecution().toString()
    assert sorted(r["key"] for r in found.collect()) == [0, 1, 2]
    free = (secret_scan.Rule("hex", "[0-9a-f]+", 0, 32),)
    assert secret_scan.candidates(secret_scan.trigram_index(spark.range(3).select(F.col("id").alias("key"), F.lit("ab").alias("text")), free), free).count() == 0


def test_spotsigs_anchors_of_all_texts(spark):
    words = [f"q{a}{b}" for a in "bcdfghjklm" for b in "bcdfghjkl"]
    # Of 12,000 texts each of the first 60 words is in a fifth, each of the others in one text less.
    texts = [(i, " ".join([f"text{i}", *(w for k, w in enumerate(words) if (i + 131 * k) % 12_000 < 2400 - (k >= 60))])) for i in range(12_000)]
    got = spotsigs.corpus_anchors(spark.createDataFrame(texts, "doc_id long, text string"))
    assert got == sorted({*spotsigs.VOCABULARY, *words[:60]})


def test_spotsigs_near_duplicates(spark, docs, empty, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sets = {r["doc_id"]: set(r["s"]) for r in spotsigs.with_signatures(table, "text", "s").collect()}
    got = {r["doc_id"]: r["class_id"] for r in spotsigs.near_duplicates(table).collect()}
    assert got == plain_components(sets) and len(set(got.values())) < len({frozenset(s) for s in sets.values()}) < len(got)
    small = Counter((r["doc_id"], r["class_id"]) for r in spotsigs.near_duplicates(docs).collect())
    assert small[5, 4] == small[4, 4] == small[3, 2] == 1 and small[1, 1] == small[None, 2] == 2
    assert spotsigs.near_duplicates(empty).count() == 0


def test_sparse_and_negative_ids(spark):
    ids = [-(2**63), -9 * 10**18, -(2**40), -5, 0, 3, 2**40, 2**40 + 1, 9 * 10**18, 2**63 - 1]
    t = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in spotsigs.with_next(spotsigs.with_signatures(spotsigs.next_texts(t), "text", "signatures")).collect()}
    assert got == {a: f"t{b}" for a, b in zip(ids, ids[1:] + ids[:1], strict=True)}


def test_chat(spark):
    turns = [
        (1, 0, "user", "a <|end|> \\ <\\| <|turn|>"), (1, 1, "assistant", "<|text|>\\\\<"), (1, 1, "assistant", "<|text|>\\\\<"),
        (2, 0, "system", "s"), (2, 1, "user", None), (2, 2, "assistant", "|> "),
        (3, None, None, None), (None, 0, "a\nb<|", "x"), (4, 0, "assistant", "first"),
    ]
    t = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(t.withColumn("formatted", F.lit(1)).withColumn("turns", F.lit(2)))
    got = {r["conv_id"]: r for r in out.select("conv_id", "valid", "segments", chat.parse_chats(F.col("formatted")).alias("back")).collect()}
    for i in (1, 2, 3, 4, None):
        assert [(p["role"], p["text"]) for p in got[i]["back"]] == [(r or "", x or "") for c, _, r, x in turns if c == i]
    assert [got[i]["valid"] for i in (1, 2, 3, 4, None)] == [False, True, False, False, False]
    assert [s["loss"] for s in got[2]["segments"]] == [False] * 7 + [True, False]
    assert chat.format_chats(t.where("false")).count() == 0


def test_toxicity(docs, empty, wide):
    model = toxicity.fit([r[1] for r in ROWS], [0] * len(ROWS))
    got = toxicity.score_toxicity(wide, model).collect()
    assert len(got) == len(ROWS) and all(r["predicted"] == 0 and 0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_toxicity(empty, model).count() == 0
    assert toxicity.fit_toxicity(empty.withColumn("toxic", F.lit(1))).terms == tuple(sorted(toxicity.SEED_TERMS))


def test_automaton_is_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    terms = ["abcab", "abcabcabca", "bcd", "ccccccccccc", "abc", "bbac"]
    lexicon, rng = toxicity.FuzzyLexicon(terms), np.random.default_rng(3)
    for _ in range(3000):
        w = "".join(rng.choice(list("abcx"), rng.integers(1, 12)))
        want = min(((distance(w, t), t) for t in terms if distance(w, t) <= toxicity.budget(t)), default=None)
        assert lexicon.find(w) == want, w
    assert toxicity.FuzzyLexicon(["abcd*"]).find("abcdzzz") == (0, "abcd*") and toxicity.FuzzyLexicon(["abcd*"]).find("abczzz") is None


def test_packing(docs, empty, wide, paths):
    got = packing.pack_documents(wide, paths[1], with_ids=True).collect()
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(r[0] for r in ROWS)
    assert all(len(r["ids"]) == r["length"] <= 4096 for r in got) and sum(r["length"] == 1 for r in got) == 4
    assert packing.pack_documents(empty, paths[1]).count() == 0


def test_best_fit():
    rng = np.random.default_rng(2)
    fit, fills = packing.BestFit(100, 8), {}
    for _ in range(2000):
        n = int(rng.integers(1, 101))
        number, offset = fit.add(n)
        assert offset == fills.get(number, 0) and offset + n <= 100
        fills[number] = offset + n
        assert len(fit.still_open()) <= 8 and all(fills[b] == f < 100 for b, f in fit.still_open())
    # The fullest bin that has room is chosen, and the fullest closes first.
    fit = packing.BestFit(10, 2)
    assert [fit.add(n)[0] for n in (6, 7, 3, 5, 4)] == [0, 1, 1, 2, 0]


def test_secrets(docs, empty, wide):
    got = {r["doc_id"]: r["spans"] for r in secret_scan.find_secrets(wide).collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in got[1]] == [("assign", 0, 25)] and got[2] == []
    assert secret_scan.find_secrets(empty).count() == 0
    out = secret_scan.redacted(wide)
    assert out.columns == wide.columns and out.count() == len(ROWS)
    assert {r["doc_id"]: r["text"] for r in out.collect()}[1] == "[SECRET] the fox"


def test_secret_spans_are_code_points(spark):
    texts = ["😀é token: secret: abcdefgh12 AKIA" + "Z" * 16, "x" + "0a" * 20 + " AKIAKIA" + "B" * 12, 'API_KEY="aaaaaaaa' + "f" * 40 + '"', "ghp_" + "a" * 36, "sk_live_" + "Q" * 20, "-----BEGIN RSA PRIVATE KEY-----"]
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secret_scan.find_secrets(t).collect()}
    for i, text in enumerate(texts):
        want = [(m.start(), n, r.kind, m.end()) for n, r in enumerate(secret_scan.RULES) for m in secret_scan.re.finditer(r.pattern, text) if len(m[r.group]) >= r.least]
        assert got[i] == [(k, a, b) for a, _, k, b in sorted(want)], text


def test_many_secrets_in_one_text(spark):
    n = 5000
    text = "".join(f"password = hunter2hunter{i} the é fox " for i in range(n))
    t = spark.createDataFrame([(1, text), (2, text), (3, "x" * 10 + text[:40])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in secret_scan.find_secrets(t).collect()}
    want = [(m.start(), m.end()) for m in secret_scan.re.finditer(r"password = hunter2hunter\d+", text)]
    assert [(s["start"], s["end"]) for s in got[1]["spans"]] == want and got[2]["spans"] == got[1]["spans"]
    assert {r["text"] for r in secret_scan.redacted(t.where("doc_id < 3")).collect()} == {"[SECRET] the é fox " * n}


def test_trigram_queries():
    q = {r.kind: secret_scan.trigram_query(r.pattern) for r in secret_scan.RULES}
    assert q["hex"] is None and q["access"] == [frozenset({"aki", "kia"})]
    assert frozenset({"tok", "oke", "ken"}) in q["assign"] and len(q["assign"]) == 6
    assert all(q[k] for k in ("github", "slack", "google", "stripe", "pem"))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, empty, wide, sf_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    for table in (docs, empty, wide):
        out = stage(spark, table, sf_dir)
        n = out.count()
        if name != "best_fit_packing":
            assert out.columns == corpus_pipeline.COLUMNS
        assert n == 0 if table is empty else n > 0
