"""The operators' queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, langid, mixing, packing, quality, secret_scan, simhash, spotsigs, tokenbin, toxicity
from .common import crc32_remainder, new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op2_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op4_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = crc32_remainder(F.col("doc_id"), 3) == 1
    model = langid.fit_languages(docs.where(~held_out))
    found = langid.identify_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-records")
    shards = tokenbin.write_token_records(_table(spark, sf_dir, "documents"), folder, _tokenizer("byte_bpe_50k.json"))
    return tokenbin.read_token_records(spark, folder, shards)


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_neighbours(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    says = "</s>[INST] ok [/INST]"
    more = spark.sql(f"select -7L as conv_id, turn, role, '{says}' as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)")
    turns = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(more)
    out = chat.format_chats(turns)
    back = out.select("conv_id", "valid", "formatted", chat.parse_chats(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc32_remainder(F.col("doc_id"), 5) == 0
    labels = _table(spark, sf_dir, "labels").where(~held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    model = fit_on_labels(docs, labels)
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def fit_on_labels(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> toxicity.ToxicityModel:
    """The sample is chosen among the labels, so only its texts are joined."""
    n = labels.where("toxic is not null").count()
    point = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("labels")), F.lit(1_000_000))
    share = 1_000_000 if n <= sample else int(1_000_000 * sample / n)
    chosen = labels.where(point < share)
    return toxicity.fit_toxicity(docs.where(point < share).join(F.broadcast(chosen), "doc_id"), sample=2 * sample)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = [r.kind for r in secret_scan.BASE]

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = secret_scan.joined(F.filter("spans", lambda s: s["kind"].isin(*kinds)))
    return found.select("doc_id", *(count(k) for k in kinds), F.sha2(base, 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {f.__name__: f for f in (op1_mix_sources, op2_quality_divergence, op3_simhash_trie, op4_language_centroids, op5_token_records, op6_spotsigs, op7_chat_format, op8_toxicity, op9_best_fit_packing, op10_secret_scan, pipeline)}


#: The mix as SQL: targets by resharing over the sources in the order in which they run dry.
OP1_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, md5(coalesce(cast(doc_id as varchar), '')) as k from documents),
s as (select source, sum(size) as n, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w from d group by source),
o as (select *, 2.0 * n / w as dry, coalesce(sum(2 * n) over (order by n / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as before,
        sum(w) over (order by n / w, source nulls last rows between current row and unbounded following) as weights, 1.5 * sum(n) over () as total from s),
c as (select *, first_value(case when (total - before) / weights <= dry then (total - before) / weights end ignore nulls) over (order by n / w, source nulls last rows between unbounded preceding and unbounded following) as cut from o),
t as (select source, cast(n as bigint) as source_size, coalesce(least(2.0 * n, w * cut), 2.0 * n) as target from c),
p as (select d.doc_id, d.size, t.source_size, t.target, floor(t.target) as goal, sum(d.size) over (partition by d.source order by d.k, d.doc_id, d.size rows between unbounded preceding and current row) - d.size as first
        from d join t on d.source is not distinct from t.source)
select doc_id, cast(size as bigint) as size, source_size, cast(target as double) as target,
    cast(greatest(0, least(size, goal - first)) + greatest(0, least(size, goal - first - source_size)) as bigint) as taken from p"""

#: Chats as SQL: what is read back is what went in, and the format adds its marks and escapes.
OP7_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 23 as n,
        lag(role, 1, 'start') over (partition by conv_id order by turn nulls first, role, text) as before from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    cast(sum(n) as bigint) as formatted_chars,
    bool_and((role = 'system' and before = 'start') or (role = 'user' and before in ('start', 'system', 'assistant')) or (role = 'assistant' and before = 'user'))
        and max_by(role, (turn, role, text)) in ('assistant', 'user') as valid
from e group by conv_id"""


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op2_sql() -> str:
    """Base counts by windows over words, histograms by regular expressions, the divergence by list arithmetic."""
    classes = ", ".join(f"len(regexp_replace(t, {_quote('[^' + c[1:-2].removeprefix('^') + ']' if not c.startswith('[^') else '[' + c[2:-2] + ']')}, '', 'g'))" for c in quality.CLASSES)
    words = ", ".join(map(_quote, quality.VOCABULARY))
    n_classes, n_words = len(quality.CLASSES) + 1, len(quality.VOCABULARY) + 1

    def total(h: str, n: int) -> str:
        return ", ".join(f"sum({h}[{i}])" for i in range(1, n + 1))

    def distance(p: str, q: str, n: int) -> str:
        x, y = f"({p}[i] / list_sum({p}))", f"({q}[i] / list_sum({q}))"
        term = "case when {a} > 0 then {a} * log2(2 * {a} / ({a} + {b})) else 0.0 end"
        return f"case when list_sum({p}) > 0 and list_sum({q}) > 0 then sqrt(greatest(0.0, list_sum(list_transform(range(1, {n + 1}), lambda i: {term.format(a=x, b=y)} + {term.format(a=y, b=x)})) / 2)) end"

    def limit(pair: tuple[float, float]) -> str:
        return f"({pair[0]} + {pair[1]} / sqrt(greatest(n_words, 1)))"

    return rf"""
with d as (select row_number() over () as id, doc_id, lang, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines, regexp_extract_all(lower(t), '\p{{L}}+') as low from d),
g as (select id, unnest(range(1, len(w) - 3)) as i, w from w where len(w) > 4),
h as (select id, i, array_to_string(w[i:i + 4], ' ') as gram from g),
r as (select id, i from (select *, count(*) over (partition by id, gram) as n from h) where n > 1),
c as (select id, count(distinct i + j) as n from r, range(5) as x(j) group by id),
f as (select w.id, doc_id, lang, cast(len(w) as bigint) as n_words, cast(len(array_to_string(w, '')) as bigint) as word_chars, cast(len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
        cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(c.n, 0) as bigint) as n_repeat_words,
        [{classes}] as c0, list_transform([{words}], lambda v: len(list_filter(low, lambda x: x = v))) as v0, len(t) as n_chars, len(low) as n_low from w left join c on w.id = c.id),
e as (select *, list_append(c0, n_chars - coalesce(list_sum(c0), 0)) as c, list_append(v0, n_low - coalesce(list_sum(v0), 0)) as v from f),
refs as (select lang, sum(n_words) as ref_words, [{total('c', n_classes)}] as rc, [{total('v', n_words)}] as rv from e group by lang),
j as (select e.*, ref_words, {distance('c', 'rc', n_classes)} as class_distance, {distance('v', 'rv', n_words)} as common_distance from e join refs on e.lang is not distinct from refs.lang),
k as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from j)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and not (n_words >= {quality.MIN_WORDS} and ref_words >= {quality.MIN_REFERENCE_WORDS}
        and (coalesce(class_distance, 0) > {limit(quality.MAX_CLASS_DISTANCE)} or coalesce(common_distance, 0) > {limit(quality.MAX_COMMON_DISTANCE)})) as kept from k"""


def op10_sql() -> str:
    """All rules on all texts, without an index; places from the lengths of matches and of what lies between them."""
    parts = []
    for place, r in enumerate(secret_scan.RULES):
        p = _quote(r.pattern.replace(r"\x20", " "))
        parts.append(f"""
select id, {place} as place, {_quote(r.kind)} as kind, starts[i] as s, starts[i] + len(found[i]) as e from (
    select *, list_transform(range(1, len(found) + 1), lambda i: cast(list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: len(x))), 0) as bigint)) as starts, unnest(range(1, len(found) + 1)) as i from (
        select id, string_split_regex(t, {p}) as gaps, regexp_extract_all(t, {p}) as found, regexp_extract_all(t, {p}, {r.group}) as part from d))
where len(part[i]) >= {r.least}""")
    base = ", ".join(_quote(r.kind) for r in secret_scan.BASE)
    text = "kind || ':' || s || ':' || e"
    counts = ", ".join(f"count(*) filter (kind = {_quote(r.kind)}) as n_{r.kind}" for r in secret_scan.BASE)
    return f"""
with d as (select row_number() over () as id, doc_id, coalesce(text, '') as t from documents),
m as ({" union all ".join(parts)})
select any_value(doc_id) as doc_id, {counts}, sha256(coalesce(string_agg({text}, ',' order by s, place) filter (kind in ({base})), '')) as base_sha256,
    coalesce(string_agg({text}, ',' order by s, place) filter (kind is not null), '') as spans
from d left join m using (id) group by id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op2_quality_divergence": op2_sql(), "op7_chat_format": OP7_SQL, "op10_secret_scan": op10_sql()}
