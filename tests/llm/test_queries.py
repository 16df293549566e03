"""The queries of the corpus operators against SQL, or against plain Python where SQL can't say it."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from cloakframe.llm import langid, packing, quality, queries, secret_scan, simhash, spotsigs, toxicity

from .test_edges import plain_components  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(sf_dir):
    return duckdb.execute(f"select * from '{sf_dir}/documents.parquet' order by doc_id").df().set_index("doc_id")


def rows(spark, sf_dir, name):
    return {r["doc_id"]: r for r in queries.queries()[name](spark, sf_dir).collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = queries.queries()[name](spark, sf_dir)
    result = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: repr(r)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=key) == sorted(result.fetchall(), key=key)


def test_op1_totals(spark, sf_dir, docs):
    got = rows(spark, sf_dir, "op1_mix_sources")
    by = {}
    for i, r in got.items():
        assert 0 <= r.taken <= 2 * r.size == 2 * len(WORD.findall(docs.text[i] or ""))
        by.setdefault(docs.source[i], []).append(r)
    targets = {s: rs[0].target for s, rs in by.items()}
    total = sum(r.size for r in got.values())
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    for s, rs in by.items():
        assert abs(sum(r.taken for r in rs) - targets[s]) < 1 and targets[s] <= 2 * rs[0].source_size
    free = [(targets[s] / w) for s, w in zip(sorted(by), [5, 2, 1] * len(by), strict=False) if targets[s] < 2 * by[s][0].source_size - 1e-6]
    assert max(free) == pytest.approx(min(free))


def test_op3_brute_force(spark, sf_dir, docs):
    got = rows(spark, sf_dir, "op3_simhash_trie")

    def plain(text):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = WORD.findall(lowered)
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    fps = {i: plain(t) for i, t in docs.text.items()}
    assert {i: f"{f:016x}" for i, f in fps.items()} == {i: r.fingerprint for i, r in got.items()}
    ids, component = sorted(fps), {i: i for i in fps}
    for _ in range(len(ids)):
        changed = False
        for a in ids:
            near = min(component[b] for b in ids if (fps[a] ^ fps[b]).bit_count() <= 3)
            if near < component[a]:
                component[a], changed = near, True
        if not changed:
            break
    assert component == {i: r.component_id for i, r in got.items()}
    assert len(set(component.values())) < len(ids)


def test_op4_held_out_accuracy(spark, sf_dir, docs):
    got = rows(spark, sf_dir, "op4_language_centroids")
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out and len(WORD.findall(docs.text[i])) > 3]
    assert sum(got[i].lang_pred == docs.lang[i] for i in held) > 0.98 * len(held)


def test_op5_reads_back_what_the_tokenizer_gives(spark, sf_dir, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t, got, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), rows(spark, sf_dir, "op5_token_records"), 0
    for i, text in docs.text.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def plain_signatures(text, anchors):
    w = [x for x in re.sub(r"[^\w]|_", " ", (text or "").lower()).split(" ") if x]
    out = set()
    for i, x in enumerate(w):
        chain = [y for y in w[i + 1 :] if y not in anchors][: spotsigs.CHAIN] if x in anchors else []
        if len(chain) == spotsigs.CHAIN:
            h = 42
            for y in [x, *chain]:
                h = xxhash.xxh64_intdigest(y.encode(), h)
            out.add(h >> 32)
    return out or ({xxhash.xxh64_intdigest(" ".join(w).encode(), 42) >> 32} if w else set())


def test_op6_brute_force(spark, sf_dir, docs):
    got, ids = rows(spark, sf_dir, "op6_spotsigs"), list(docs.index)
    anchors = set(spotsigs.corpus_anchors(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    sets = {i: plain_signatures(t, anchors) for i, t in docs.text.items()}
    assert {i: r.class_id for i, r in got.items()} == plain_components(sets)
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for n, i in enumerate(ids):
        text, after, r = docs.text[i] or "", docs.text[ids[(n + 1) % len(ids)]] or "", got[i]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = (plain_signatures(t, anchors) for t in (text, edited, after))
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == "".join(f"{x:08x}" for x in sorted(a)) and r.edited_fingerprint == "".join(f"{x:08x}" for x in sorted(b))
        assert (r.near_edited, r.near_next) == pytest.approx((jaccard(a, b), jaccard(a, c)))


def test_op8_held_out(spark, docs):
    sf = "/root/testdata/sf0.1"
    got = rows(spark, sf, "op8_toxicity")
    labels = duckdb.execute(f"select doc_id, toxic from '{sf}/labels.parquet'").fetchall()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[i].score, y) for i, y in labels if got[i].held_out]
    positive, negative = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in positive for b in negative])
    assert auc > 0.93 and sum(s >= 0.5 for s in positive) > 0.85 * len(positive) and sum(s >= 0.5 for s in negative) < 0.02 * len(negative)


def check_packing(got, want_ids, capacity=4096):
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, ids in want_ids.items():
        pieces = sorted(by_doc.pop(i), key=lambda r: r.piece)
        assert [(p.piece, p.start, p.length) for p in pieces] == [(k, a, min(capacity, len(ids) - a)) for k, a in enumerate(range(0, len(ids), capacity))]
        assert [p.ids_crc32 for p in pieces] == [zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for p in pieces]
    assert not by_doc
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return len(by_sequence)


def test_op9_packs_tightly(spark, sf_dir, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in docs.text.items()}
    n = check_packing(queries.op9_best_fit_packing(spark, sf_dir).collect(), want)
    assert n <= 1.03 * sum(map(len, want.values())) / 4096 + 2
    # Dealt over many tasks, the open bins are merged over several rounds.
    many = packing.pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(70), public_tokenizers.path("word_bpe_49k.json"))
    assert check_packing(many.collect(), want) <= 1.1 * sum(map(len, want.values())) / 4096 + 2


def test_pipeline_brute_force(spark, sf_dir, docs):
    """The stages in plain Python over the operators' plain parts; the last stage's pieces are held to what the mix gives."""
    import public_tokenizers
    from tokenizers import Tokenizer

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit_languages(table)
    kept = [i for i, (_, _, rejected) in zip(docs.index, model.predict(list(docs.text)), strict=True) if not rejected]
    assert len(kept) > 0.97 * len(docs)
    words = {i: re.findall(rb"[^\x20\x09-\x0D]+", docs.text[i].encode().lower()) for i in kept}
    sets = {i: {b" ".join(w[k : k + 5]) for k in range(len(w) - 4)} or {b" ".join(w)} for i, w in words.items()}
    component = {i: i for i in kept}
    for _ in kept:
        new = {a: min(component[b] for b in kept if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])) for a in kept}
        if new == component:
            break
        component = new
    first = [i for i in kept if component[i] == i]
    masked = {}
    for i in first:
        text, spans = docs.text[i], []
        for r in secret_scan.RULES:
            spans += [m.span() for m in re.finditer(r.pattern, text) if len(m[r.group]) >= r.least]
        out, at = "", 0
        for a, b in sorted(spans):
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        masked[i] = out + text[at:]
    size = {i: len(WORD.findall(t)) for i, t in masked.items()}
    sources = sorted({docs.source[i] for i in first})
    total = {s: sum(size[i] for i in first if docs.source[i] == s) for s in sources}
    weight = dict(zip(sources, [5, 2, 1] * len(sources), strict=False))
    left, budget, target = dict(total), 1.5 * sum(total.values()), {}
    while left:
        level = budget / sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * level > 2 * total[s]]
        if not over:
            target |= {s: weight[s] * level for s in left}
            break
        for s in over:
            target[s] = 2 * total[s]
            budget -= left.pop(s) * 2
    want = Counter()
    for s in sources:
        room = int(target[s] + 1e-9)
        order = sorted((i for i in first if docs.source[i] == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        for i in [*order, *order]:
            n = min(size[i], room)
            room -= n
            if n == size[i] > 0:
                want[i, masked[i]] += 1
            elif n > 0:
                want[i, masked[i][: list(WORD.finditer(masked[i]))[n - 1].end()]] += 1
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = Counter()
    for (i, text), n in want.items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            pieces[i, k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())] += n
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all([a for a, _ in sorted(v)] == [sum(n for _, n in sorted(v)[:k]) for k in range(len(v))] for v in used.values())


@pytest.fixture(scope="module")
def labelled():
    """Held-in and held-out labelled texts, and the model of the first."""
    sf = "/root/testdata/sf0.1"
    rows = duckdb.execute(f"select doc_id, max(toxic), any_value(text) from '{sf}/labels.parquet' join '{sf}/documents.parquet' using (doc_id) where toxic is not null group by 1 order by 1").fetchall()
    held_out = [zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows]
    inside, outside = ([(y, t) for (_, y, t), h in zip(rows, held_out, strict=True) if h == k] for k in (False, True))
    return toxicity.fit([t for _, t in inside], [y for y, _ in inside], seeds=()), outside


def test_toxicity_learns_its_terms(labelled):
    """Without any seed term; the four languages' toxic words are learned from the labels alone."""
    model, held = labelled
    scores, y = model.score([t for _, t in held]), np.array([y for y, _ in held])
    positive, negative = scores[y == 1], scores[y == 0]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in positive for b in negative]) > 0.94
    assert (positive >= 0.5).mean() > 0.9 and (negative >= 0.5).mean() < 0.02


def test_toxicity_needs_edits_and_context(labelled):
    model, held = labelled
    terms, rng = {t for t in model.terms if not t.endswith("*")}, np.random.default_rng(1)

    def spoiled(word):
        if len(word) < 5 or word.lower().strip(".,;") not in terms:
            return word
        i = int(rng.integers(1, len(word) - 1))
        return word[:i] + str(rng.choice(list("xyzqkw"))) + word[i + 1 :]

    bad = [" ".join(map(spoiled, t.split(" "))) for y, t in held if y]
    with_edits, without = ((model.score(bad, edits=e) >= 0.5).mean() for e in (True, False))
    assert with_edits > without + 0.15
    quoting = [t[:400] + ' he said "you are an idiot" and wrote the word "moron" there ' + t[400:] for y, t in held if not y]
    with_context, without = ((model.score(quoting, context=c) >= 0.5).mean() for c in (True, False))
    assert with_context < 0.05 < 0.9 < without


def test_toxicity_score_by_brute_force(labelled):
    """Scores from edit distances to every term, word by word."""
    model, held = labelled

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, z in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != z)))
        return row[-1]

    def hit(word):
        near = [(d, t) for t in model.terms if not t.endswith("*") and abs(len(t) - len(word)) <= toxicity.budget(t) and (d := distance(word, t)) <= toxicity.budget(t)]
        stem = next(((0, s) for s in sorted(model.terms, key=len, reverse=True) if s.endswith("*") and word.startswith(s[:-1])), None)
        if near and min(near)[0] == 0:
            return min(near)
        return stem or (min(near) if near and word not in model.clean else None)

    for _, text in held[:40]:
        low, sums = text.lower()[:3000], [0.0] * 4
        for m in toxicity._TOKEN.finditer(low):
            if found := hit(toxicity._plain(m[0])):
                q, w = toxicity.quotation(low, *m.span()), model.strength.get(found[1], 1.0) / (1 + model.false.get(found[1], 0) if found[0] else 1)
                sums[2 if found[1].endswith("*") else 1 if found[0] else 0] += (1 - q) * w
                sums[3] += q * w
        want = 1 / (1 + np.exp(-(np.array([*np.log1p(sums), 1.0]) @ np.array(model.weights))))
        assert model.score([text[:3000]])[0] == pytest.approx(want)


def test_toxicity_spelling_and_quotation():
    model = toxicity.fit([], [])
    direct, spelled, quoted, clean = model.score(["you are a worthless idiot, a stupid idiot", "you are a w0rthles id1ot, a stupyd idiott", 'he wrote "idiot" there', "a nice day"])
    assert direct > 0.5 and spelled > 0.5 and quoted < 0.5 and clean < 0.1
