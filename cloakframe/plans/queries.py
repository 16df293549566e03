"""The engine's queries over the given tables, each with SQL for the same rows.

Identifiers are derived from integer keys by one rule in both languages: every 7th key is corrupted, every 11th is blank.
Nothing random is in any result: aliases and tokens show up as counts, or are undone.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, headers, identifiers
from ..operators import guards, inspect, maps, policy, registry, restore, scrub
from ..operators.anonymize import Sheet, anonymize, coverage_differences, extend_entity_map
from ..sources.tables import dense, place, sized, store, to_cells, to_wide
from ..sources.xlsx import sink_problems
from ..types import Action, FieldRule, FieldType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Derived identifiers. These SQL texts hold in Spark and in DuckDB.


#: Checksum weights of the published rule, written out here so that the SQL doesn't share the validators' own.
_TEN, _ELEVEN, _TWELVE = (2, 4, 10, 3, 5, 9, 4, 6, 8), (7, 2, 4, 10, 3, 5, 9, 4, 6, 8), (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)


def _weighted(text: str, weights: tuple[int, ...]) -> str:
    return "((" + " + ".join(f"cast(substr({text}, {i}, 1) as int) * {w}" for i, w in enumerate(weights, 1)) + ") % 11 % 10)"


def _corrupt(good: str, key: str, n: int) -> str:
    """The n-digit text with another last digit for every 7th key, blank for every 11th."""
    return f"case when {key} % 11 = 0 then ' ' when {key} % 7 = 0 then concat(substr({good}, 1, {n - 1}), cast((cast(substr({good}, {n}, 1) as int) + 1) % 10 as string)) else {good} end"


def _inn10(key: str) -> str:
    base = f"lpad(cast(770700000 + {key} as string), 9, '0')"
    return f"concat({base}, cast({_weighted(base, _TEN)} as string))"


def _ogrn13(key: str) -> str:
    base = f"cast(104770900000 + {key} as string)"
    return f"concat({base}, cast(cast({base} as bigint) % 11 % 10 as string))"


def _ogrnip15(key: str) -> str:
    base = f"cast(30477090000000 + {key} as string)"
    return f"concat({base}, cast(cast({base} as bigint) % 13 % 10 as string))"


def _kpp9(key: str) -> str:
    return f"concat(lpad(cast(1000 + {key} % 9000 as string), 4, '0'), case when {key} % 3 = 0 then 'AB' else '01' end, lpad(cast({key} % 1000 as string), 3, '0'))"


INN, OGRN, OGRNIP = _corrupt(_inn10("k"), "k", 10), _corrupt(_ogrn13("k"), "k", 13), _corrupt(_ogrnip15("k"), "k", 15)
KPP = f"case when k % 11 = 0 then ' ' when k % 7 = 0 then lower(concat('a', substr({_kpp9('k')}, 2))) else {_kpp9('k')} end"
IDS = f"select k, {INN} as inn, {OGRN} as ogrn, {OGRNIP} as ogrnip, {KPP} as kpp"
FROM_CUSTOMER = "(select c_custkey as k from customer)"


def derived(spark: SparkSession, sf_dir: str, name: str = "customer", key: str = "c_custkey") -> DataFrame:
    """(k, inn, ogrn, ogrnip, kpp)."""
    return table(spark, sf_dir, name).select(F.col(key).alias("k")).selectExpr("k", f"{INN} as inn", f"{OGRN} as ogrn", f"{OGRNIP} as ogrnip", f"{KPP} as kpp")


# What is valid, by the rule that made the keys: arithmetic of its own, not the validators.
_DUCK_OK = {
    "inn": f"case when regexp_full_match(trim(inn), '[0-9]{{10}}') then {_weighted('inn', _TEN)} = cast(substr(inn, 10, 1) as int) else false end",
    "ogrn": "case when regexp_full_match(trim(ogrn), '[0-9]{13}') then cast(substr(ogrn, 1, 12) as bigint) % 11 % 10 = cast(substr(ogrn, 13, 1) as int) else false end",
    "ogrnip": "case when regexp_full_match(trim(ogrnip), '[0-9]{15}') then cast(substr(ogrnip, 1, 14) as bigint) % 13 % 10 = cast(substr(ogrnip, 15, 1) as int) else false end",
    "kpp": "regexp_full_match(trim(kpp), '[0-9]{4}[0-9A-Z]{2}[0-9]{3}')",
}


def _validity(kind: str, check) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return derived(spark, sf_dir).select("k", F.col(kind).alias("value"), check(identifiers.candidate(F.col(kind), "string")).alias("valid"))

    run.__name__ = f"{kind}_validity"
    query(f"select k, {kind} as value, {_DUCK_OK[kind]} as valid from ({IDS} from {FROM_CUSTOMER})")(run)


for _kind, _check in (("inn", identifiers.is_inn), ("ogrn", identifiers.is_ogrn13), ("ogrnip", identifiers.is_ogrnip), ("kpp", identifiers.is_kpp)):
    _validity(_kind, _check)

_W11, _W12 = (_weighted("lpad(cast(k as string), 10, '5')", _ELEVEN), _TWELVE)


@query(f"""
    with v as (select k, concat(lpad(cast(k as string), 10, '5'), cast({_W11} as string)) as b from {FROM_CUSTOMER}),
         w as (select k, concat(b, cast({_weighted('b', _TWELVE)} as string)) as good from v),
         x as (select k, case when k % 5 = 0 then concat(substr(good, 1, 10), cast((cast(substr(good, 11, 1) as int) + 1) % 10 as string), substr(good, 12)) else good end as value, k % 5 <> 0 as valid from w)
    select k, value, valid from x""")
def inn12_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve digits with two check digits; the first of them is wrong for every 5th key."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).selectExpr("k", f"concat(lpad(cast(k as string), 10, '5'), cast({_W11} as string)) as b")
    good = c.selectExpr("k", f"concat(b, cast({_weighted('b', _TWELVE)} as string)) as good")
    value = good.selectExpr("k", "case when k % 5 = 0 then concat(substr(good, 1, 10), cast((cast(substr(good, 11, 1) as int) + 1) % 10 as string), substr(good, 12)) else good end as value")
    return value.withColumn("valid", identifiers.is_inn(F.col("value")))


@query(f"""
    select source, type, count(*) as n from (
        select 'inn' as source, case when {_DUCK_OK['inn']} then 'inn' else 'unknown' end as type from ({IDS} from {FROM_CUSTOMER})
        union all select 'ogrn', case when {_DUCK_OK['ogrn']} then 'ogrn' else 'unknown' end from ({IDS} from {FROM_CUSTOMER})
        union all select 'ogrnip', case when {_DUCK_OK['ogrnip']} then 'ogrn' else 'unknown' end from ({IDS} from {FROM_CUSTOMER})
        union all select 'kpp', 'unknown' from {FROM_CUSTOMER}) group by source, type""")
def value_type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected types of derived identifiers; a kpp is never told by its value."""
    cells = F.array(*[F.struct(F.lit(c).alias("source"), identifiers.value_type(identifiers.candidate(F.col(c), "string")).alias("type")) for c in ("inn", "ogrn", "ogrnip", "kpp")])
    return derived(spark, sf_dir).select(F.explode(cells).alias("x")).groupBy("x.source", "x.type").agg(F.count("*").alias("n"))


_HEADERS = [("  Компания ", "company"), ("ИНН   контрагента", "inn"), ("E-MAIL", "email"), ("Ф.И.О.", "person"), ("Выручка", "financial"), ("КПП", "kpp"), ("ОГРНИП", "ogrn"), ("Филиал", "branch"), ("отдел", "department"), ("Телефон", "phone"), ("адрес", "address"), ("прочее", "unknown"), ("ИНН2", "unknown"), ("", "unknown")]


@query("select * from (values " + ", ".join(f"('{h}', '{t}')" for h, t in _HEADERS) + ") as t(header, field_type)")
def column_type_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(h, headers.column_type(h)) for h, _ in _HEADERS], "header string, field_type string")


# Anonymization


def rule(field_type: str, action: str, name: str = "") -> FieldRule:
    return FieldRule(name, FieldType(field_type), Action(action))


def _customers(spark: SparkSession, sf_dir: str) -> Sheet:
    t = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 2).alias("row"), F.col("c_name").alias(place(1)), F.col("c_mktsegment").alias(place(2)), F.col("c_acctbal").alias(place(3)), F.col("c_nationkey").alias(place(4)))
    rules = {1: rule("company", "pseudonymize"), 2: rule("department", "keep"), 3: rule("financial", "keep"), 4: rule("branch", "remove")}
    return Sheet("customer", t, rules)


def _suppliers(spark: SparkSession, sf_dir: str) -> Sheet:
    t = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 2).alias("row"), F.col("s_name").alias(place(1)), F.concat(F.lit("Customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias(place(2)))
    return Sheet("supplier", t, {1: rule("company", "pseudonymize"), 2: rule("company", "pseudonymize")})


def _entities(spark: SparkSession) -> DataFrame:
    return maps.empty(spark, maps.ENTITY_MAP)


def _tokens(spark: SparkSession) -> DataFrame:
    return maps.empty(spark, maps.IDENTIFIER_MAP)


@query("select c_custkey + 2 as row_number, c_mktsegment as kept, cast(null as int) as removed, c_acctbal as amount from customer")
def keep_remove_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _customers(spark, sf_dir)
    out = anonymize([s], _entities(spark), "job").sheets["customer"]
    return out.select(F.col("row").alias("row_number"), F.col(place(2)).alias("kept"), F.col(place(4)).alias("removed"), F.col(place(3)).alias("amount"))


@query("select c_custkey, c_name, c_mktsegment, c_acctbal from customer")
def entity_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restored after anonymization, by value."""
    done = anonymize([_customers(spark, sf_dir)], _entities(spark), "job")
    back = restore.restore_analytical(done.sheets["customer"], done.entity_map)
    return back.select((F.col("row") - 2).alias("c_custkey"), F.col(place(1)).alias("c_name"), F.col(place(2)).alias("c_mktsegment"), F.col(place(3)).alias("c_acctbal"))


def _identified(spark: SparkSession, sf_dir: str) -> Sheet:
    """Valid identifiers only: text and integer columns, blanks among them."""
    k = F.col("c_custkey").alias("k")
    t = table(spark, sf_dir, "customer").select(k).selectExpr("k", f"case when k % 11 = 0 then ' ' else {_inn10('k')} end as inn", f"cast({_ogrn13('k')} as bigint) as ogrn", f"{_kpp9('k')} as kpp")
    t = t.select((F.col("k") + 2).alias("row"), F.col("inn").alias(place(1)), F.col("ogrn").alias(place(2)), F.col("kpp").alias(place(3)))
    return Sheet("ids", t, {1: rule("inn", "pseudonymize"), 2: rule("ogrn", "pseudonymize"), 3: rule("kpp", "pseudonymize")})


@query(f"select c_custkey + 2 as row_number, case when c_custkey % 11 = 0 then ' ' else {_inn10('c_custkey')} end as inn, cast({_ogrn13('c_custkey')} as bigint) as ogrn, {_kpp9('c_custkey')} as kpp from customer")
def identifier_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens restored by coordinates, integers as integers."""
    s = _identified(spark, sf_dir)
    done = anonymize([s], _entities(spark), "job", _tokens(spark))
    cells = to_cells(done.sheets["ids"], ["ИНН", "ОГРН", "КПП"], sheet_name="ids")
    back = restore.restore(cells, done.provenance, done.entity_map, done.identifier_map)
    body = back.where("row > 1")
    return body.groupBy(F.col("row").cast("long").alias("row_number")).agg(F.max(F.when(F.col("column") == 1, F.col("s"))).alias("inn"), F.max(F.when(F.col("column") == 2, F.col("i"))).cast("bigint").alias("ogrn"), F.max(F.when(F.col("column") == 3, F.col("s"))).alias("kpp"))


@query(f"""select representation, count(*) as n from (
    select 'string' as representation from customer where c_custkey % 11 <> 0 union all select 'integer' from customer union all select 'string' from customer) group by representation""")
def provenance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One provenance row for each cell that got a token."""
    done = anonymize([_identified(spark, sf_dir)], _entities(spark), "job", _tokens(spark))
    return done.provenance.groupBy("representation").agg(F.count("*").alias("n"))


@query("select count(distinct c_name) as n_values, count(distinct c_name) as n_aliases, cast(0 as bigint) as n_bad_prefix, cast(0 as bigint) as n_bad_shape, count(distinct c_name) as last_seq from customer")
def alias_bijection(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = anonymize([_customers(spark, sf_dir)], _entities(spark), "job").entity_map
    return m.agg(F.countDistinct("real_value").alias("n_values"), F.countDistinct("alias").alias("n_aliases"), F.count_if(~F.col("alias").startswith("C_")).alias("n_bad_prefix"), F.count_if(~F.col("alias").rlike(r"^[A-Z]+_[0-9A-HJKMNP-TV-Z]{9}\z")).alias("n_bad_shape"), F.max("seq").alias("last_seq"))


@query("select count(*) as n_rows, cast(0 as bigint) as n_changed, cast(0 as bigint) as n_new_aliases from customer")
def alias_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run over the same table changes nothing and adds nothing."""
    s = _customers(spark, sf_dir)
    a = anonymize([s], _entities(spark), "one")
    b = anonymize([s], a.entity_map, "two")
    joined = a.sheets["customer"].select("row", F.col(place(1)).alias("x")).join(b.sheets["customer"].select("row", F.col(place(1)).alias("y")), "row")
    more = b.entity_map.join(a.entity_map.select("alias"), "alias", "left_anti").agg(F.count("*").alias("n_new_aliases"))
    counts = joined.agg(F.count("*").alias("n_rows"), F.count_if(F.col("x") != F.col("y")).alias("n_changed"))
    return counts.join(more)  # two rows of one row each


@query("""select (select count(*) from (select c_name from customer union select s_name from supplier union select concat('Customer#', lpad(cast(s_suppkey as varchar), 9, '0')) from supplier)) as n_identities,
    (select count(*) from supplier where concat('Customer#', lpad(cast(s_suppkey as varchar), 9, '0')) in (select c_name from customer)) as n_shared""")
def multi_table_shared_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One map over two tables: a value has one alias wherever it occurs."""
    done = anonymize([_customers(spark, sf_dir), _suppliers(spark, sf_dir)], _entities(spark), "job")
    shared = done.sheets["supplier"].join(done.sheets["customer"].select(F.col(place(1)).alias("alias")), F.col(place(2)) == F.col("alias"), "left_semi")
    return done.entity_map.agg(F.count("*").alias("n_identities")).join(shared.agg(F.count("*").alias("n_shared")))


@query("select c_custkey + 2 as row_number, case when c_custkey % 4 = 0 then 'alias' else 'value' end as shown from customer")
def provenance_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias-like cells at recorded coordinates are left to the coordinate pass; all others are restored by value."""
    s = _customers(spark, sf_dir)
    done = anonymize([s], _entities(spark), "job")
    only = done.sheets["customer"].select("row", place(1))
    cells = to_cells(only, ["Компания"], sheet_name="customer")
    held = only.where((F.col("row") - 2) % 4 == 0).select(F.lit("customer").alias("sheet_name"), F.col("row").cast("long").alias("row"), F.lit(1).alias("column"))
    plan = restore.resolve_entities(cells, held, done.entity_map)
    x = cells.where("row > 1").join(plan.select("row", "value"), "row", "left")
    return x.select(F.col("row").cast("long").alias("row_number"), F.when(F.col("value").isNull(), "alias").otherwise("value").alias("shown"))


@query("""select c.c_name as company, cast(sum(cast(o.o_totalprice as decimal(18,2))) as double) as revenue, count(*) as n_orders
    from orders o join customer c on o.o_custkey = c.c_custkey group by c.c_name""")
def analytical_restore_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by company, worked out on anonymized rows and restored by value afterwards."""
    done = anonymize([_customers(spark, sf_dir)], _entities(spark), "job")
    anonymous = done.sheets["customer"].select((F.col("row") - 2).alias("o_custkey"), F.col(place(1)).alias("company"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    revenue = orders.join(sized(anonymous), "o_custkey").groupBy("company").agg(F.sum("price").cast("double").alias("revenue"), F.count("*").alias("n_orders"))
    return restore.restore_analytical(revenue, done.entity_map)


@query("select count(distinct o_custkey) as n_entities, cast(0 as bigint) as n_identifiers from orders")
def analytical_restore_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = anonymize([_customers(spark, sf_dir)], _entities(spark), "job")
    anonymous = done.sheets["customer"].select((F.col("row") - 2).alias("o_custkey"), F.col(place(1)).alias("company"))
    derived_table = table(spark, sf_dir, "orders").join(anonymous, "o_custkey").groupBy("company").agg(F.count("*").alias("n"))
    return restore.count_restored(derived_table, done.entity_map, _tokens(spark))


@query("select * from (values ('a', cast(1 as bigint))) as t(\"column\", n)")
def ambiguous_restore_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.createDataFrame([("C_000000001", "x"), ("X", "INN_00000001"), (None, " ")], "a string, b string")
    e = spark.createDataFrame([(1, "C_000000001", "v", "company", None)], maps.ENTITY_MAP)
    i = spark.createDataFrame([(1, "C_000000001", "7707083893", "inn"), (2, "INN_00000001", "7707083886", "inn")], maps.IDENTIFIER_MAP)
    return restore.ambiguous(t, e, i)


@query("""select * from (values (4, 'missing'), (7, 'extra')) as t("column", problem)""")
def rule_coverage_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = len(table(spark, sf_dir, "customer").columns)
    columns = spark.createDataFrame([("customer", i) for i in range(1, width + 1)], "sheet string, column int")
    rules = spark.createDataFrame([("customer", i) for i in (1, 2, 3, 5, 7)], "sheet string, column int")
    return coverage_differences(rules, columns).select("column", "problem")


@query("""select field_type, action, case action when 'keep' then 'keep_forbidden_for_type' else 'pseudonymize_unsupported_for_type' end as reason
    from (values ('company'), ('branch'), ('department'), ('person'), ('inn'), ('kpp'), ('ogrn'), ('phone'), ('email'), ('address'), ('financial'), ('unknown')) as f(field_type),
         (values ('keep'), ('remove'), ('pseudonymize')) as a(action)
    where (action = 'keep' and field_type in ('company', 'person', 'phone', 'email', 'address', 'unknown'))
       or (action = 'pseudonymize' and field_type not in ('company', 'person', 'inn', 'kpp', 'ogrn'))""")
def action_matrix_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("s", n, "", t.value, a.value) for n, (t, a) in enumerate((t, a) for t in FieldType for a in Action)], policy.RULES)
    return policy.action_violations(rules).select("field_type", "action", "reason")


@query(f"""with ids as ({IDS} from {FROM_CUSTOMER}),
    bad as (select k + 2 as r, case when k % 13 = 0 then 'formula' when k % 11 <> 0 and not ({_DUCK_OK['inn']}) then 'invalid' end as reason from ids)
    select r as "row", 1 as "column", reason from bad where reason is not null order by r limit 1""")
def first_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first cell that stops a job, in row-major order."""
    t = derived(spark, sf_dir).select((F.col("k") + 2).alias("row"), F.when(F.col("k") % 13 == 0, "=A1").otherwise(F.col("inn")).alias(place(1)))
    return guards.first_violation(guards.violations(t, {1: rule("inn", "pseudonymize")}))


@query(f"""with ids as ({IDS} from {FROM_CUSTOMER}),
    bad as (select k, case when k % 13 = 0 then 'formula' when k % 11 <> 0 and not ({_DUCK_OK['inn']}) then 'invalid' end as reason from ids)
    select reason, count(*) as n from bad where reason is not null group by reason""")
def violation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = derived(spark, sf_dir).select((F.col("k") + 2).alias("row"), F.when(F.col("k") % 13 == 0, "=A1").otherwise(F.col("inn")).alias(place(1)))
    return guards.violations(t, {1: rule("inn", "pseudonymize")}).groupBy("reason").agg(F.count("*").alias("n"))


# Policy gate


def _policy_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company, inn as text, an amount that is sometimes nine digits, a branch that is sometimes an ogrn."""
    t = derived(spark, sf_dir).select((F.col("k") + 2).alias("row"), F.concat(F.lit("ООО "), F.col("k").cast("string")).alias(place(1)), F.col("inn").alias(place(2)), F.when(F.col("k") % 5 == 0, 123456000 + F.col("k")).otherwise(F.col("k")).alias(place(3)), F.when(F.col("k") % 9 == 0, F.col("ogrn")).otherwise(F.lit("север")).alias(place(4)))
    return to_cells(t, ["Компания", "ИНН", "Выручка", "Филиал"], sheet_name="Data")


_RULES = {"Data": {1: rule("company", "pseudonymize", "Компания"), 2: rule("inn", "pseudonymize", "ИНН"), 3: rule("financial", "keep", "Выручка"), 4: rule("branch", "keep", "филиал")}}


@query(f"""with ids as ({IDS} from {FROM_CUSTOMER})
    select k + 2 as row_number, 3 as column_number from ids where k % 5 = 0 or length(cast(k as varchar)) = 9
    union all select k + 2, 4 from ids where k % 9 = 0 and ({_DUCK_OK['ogrn']})""")
def keep_cross_type_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept cells that look like identifiers; nine digits look like a kpp."""
    v = policy.keep_violations(_policy_cells(spark, sf_dir), policy.rules_table(spark, _RULES))
    return v.select(F.col("row").cast("long").alias("row_number"), F.col("column").alias("column_number"))


@query("select 1 as sheet_index, 2 as column_number, 'inn' as identifier_type, count(*) as expected from customer where c_custkey % 11 <> 0")
def expected_identifier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank cells, invalid ones too."""
    return policy.expected_identifiers(_policy_cells(spark, sf_dir), policy.rules_table(spark, _RULES)).select("sheet_index", F.col("column").alias("column_number"), "identifier_type", "expected")


@query("select 'Data' as sheet_name, 4 as column_number")
def header_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers are compared exactly, case and all."""
    return policy.header_mismatches(_policy_cells(spark, sf_dir), policy.rules_table(spark, _RULES)).select("sheet_name", F.col("column").alias("column_number"))


@query("""with c as (select count(*) as n from customer) select t.* from (values ('customer', 'missing_worksheet_policy'), ('ghost', 'policy_for_unknown_worksheet'), (null, 'no_visible_process_worksheet')) as t(sheet_name, reason), c where n > 0""")
def worksheet_policy_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheets = spark.createDataFrame([(1, "customer", "visible", 9, 9), (2, "hidden", "hidden", 9, 9), (3, "notes", "visible", 9, 9)], "sheet_index int, title string, state string, max_row int, max_column int")
    policies = spark.createDataFrame([("hidden", "process"), ("notes", "remove_all"), ("ghost", "process")], policy.POLICIES)
    return policy.coverage_problems(sheets, policies).select("sheet_name", "reason")


@query("select * from (values ('a', 'missing_process_rules'), ('b', 'rules_for_remove_all_worksheet'), ('z', 'rules_for_unknown_worksheet')) as t(sheet_name, reason)")
def process_rule_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies = spark.createDataFrame([("a", "process"), ("b", "remove_all"), ("c", "process")], policy.POLICIES)
    rules = spark.createDataFrame([(s, 1, "", "inn", "remove") for s in ("b", "c", "z")], policy.RULES)
    return policy.rule_problems(policies, rules).select("sheet_name", "reason")


@query("select * from (values (1, 'a'), (2, 'c')) as t(sheet_index, title)")
def remaining_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheets = spark.createDataFrame([(1, "a", "visible", 1, 1), (2, "b", "visible", 1, 1), (3, "c", "hidden", 1, 1)], "sheet_index int, title string, state string, max_row int, max_column int")
    policies = spark.createDataFrame([("a", "process"), ("b", "remove_all"), ("c", "process")], policy.POLICIES)
    return policy.remaining_sheets(sheets, policies).select("sheet_index", "title")


# Inspection


def _order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cells: the customer's name, its inn as an integer, a formula for every 50th order, a comment for every 20th."""
    o = table(spark, sf_dir, "orders").join(sized(table(spark, sf_dir, "customer").select("c_custkey", "c_name")), F.col("o_custkey") == F.col("c_custkey"))
    t = o.select(F.col("o_orderkey").cast("long").alias("row"), F.when(F.col("o_orderkey") % 50 == 0, "=A1").otherwise(F.col("c_name")).alias(place(1)), F.expr(f"cast({_inn10('o_custkey')} as bigint)").alias(place(2)))
    return to_cells(t, ["Компания", "ИНН"], sheet_name="orders").withColumn("has_comment", (F.col("row") % 20 == 0) & (F.col("column") == 2))


def _maps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every third customer's name and every fifth one's inn are known."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    e = c.where("k % 3 = 0").select(F.col("k").alias("seq"), F.concat(F.lit("C_"), F.col("k").cast("string")).alias("alias"), F.col("c_name").alias("real_value"), F.lit("company").alias("entity_type"), F.lit(None).cast("string").alias("parent_alias"))
    i = c.where("k % 5 = 0").select(F.col("k").alias("seq"), F.concat(F.lit("INN_"), F.col("k").cast("string")).alias("token"), F.expr(_inn10("k")).alias("identifier_value"), F.lit("inn").alias("identifier_type"))
    return e, i


@query("select o_orderkey as row_number, 1 as column_number from orders where o_custkey % 3 = 0 and o_orderkey % 50 <> 0")
def known_entity_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = _maps(spark, sf_dir)
    return inspect.value_hits(_order_cells(spark, sf_dir), inspect.known_values(e, None)).select(F.col("row").cast("long").alias("row_number"), F.col("column").alias("column_number"))


@query("select o_orderkey as row_number, 2 as column_number from orders where o_custkey % 5 = 0")
def known_identifier_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers are compared as digits."""
    _, i = _maps(spark, sf_dir)
    return inspect.value_hits(_order_cells(spark, sf_dir), inspect.known_values(None, i)).select(F.col("row").cast("long").alias("row_number"), F.col("column").alias("column_number"))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = _maps(spark, sf_dir)
    cells = _order_cells(spark, sf_dir)
    sheets = spark.createDataFrame([(1, "orders", "visible", 9, 2), (2, "x", "hidden", 1, 1)], "sheet_index int, title string, state string, max_row int, max_column int")
    parts = spark.createDataFrame([("xl/media/a.png",), ("xl/drawings/d1.xml",), ("xl/drawings/_rels/d1.xml.rels",)], "name string")
    properties = spark.createDataFrame([("core", "creator", "me"), ("custom", "JobId", "j"), ("custom", "Other", "o")], "scope string, name string, value string")
    return inspect.inspect(cells, sheets, properties, parts, None, e, i)


_FINDINGS_SQL = """(select 'known_entity_value' as kind, o_orderkey as r, 1 as c from orders where o_custkey % 3 = 0 and o_orderkey % 50 <> 0
    union all select 'known_identifier_value', o_orderkey, 2 from orders where o_custkey % 5 = 0
    union all select 'formula', o_orderkey, 1 from orders where o_orderkey % 50 = 0
    union all select 'comment', o_orderkey, 2 from orders where o_orderkey % 20 = 0
    union all select 'hidden_worksheet', null, null union all select 'media', null, null union all select 'drawing', null, null
    union all select 'core_property', null, null union all select 'custom_property', null, null)"""


@query(f"select kind, case when kind like 'known%' then 'blocking' else 'unverified' end as severity, count(*) as n from {_FINDINGS_SQL} group by kind")
def finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.counts(_findings(spark, sf_dir))


@query(f"""select kind, r as row_number, c as column_number, n > 100 as truncated, p as place from (
    select *, row_number() over (partition by kind order by r, c) as p, count(*) over (partition by kind) as n from {_FINDINGS_SQL}) where p <= 100""")
def findings_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred of each kind, as the report shows them."""
    d = inspect.details(_findings(spark, sf_dir))
    return d.select("kind", F.col("row").cast("long").alias("row_number"), F.col("column").alias("column_number"), "truncated", F.col("place").cast("long").alias("place"))


@query(f"select true as has_blocking_findings, true as has_unverified_exposures, count(*) as n, 'known_entity_value_present' as reason from {_FINDINGS_SQL}")
def inspection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _findings(spark, sf_dir)
    return inspect.report(f).join(inspect.refusal(f))


_PARTS = [("xl/externalLinks/externalLink1.xml", "external_link"), ("xl/drawings/drawing1.xml", "drawing"), ("xl/drawings/vmlDrawing1.vml", None), ("xl/charts/chart1.xml", "chart"), ("xl/charts/style1.xml", None), ("xl/chartsheets/sheet1.xml", "chartsheet"), ("XL/MEDIA/Image.PNG", "media"), ("xl/embeddings/o.bin", "embedding"), ("xl/pivotCache/p.xml", "pivot"), ("xl/pivotTables/p.xml", "pivot"), ("customXml/item1.xml", "custom_xml"), ("xl/vbaProject.bin", "vba"), ("xl/threadedComments/t.xml", "threaded_comment"), ("xl/persons/p.xml", "threaded_comment"), ("xl/drawings/_rels/drawing1.xml.rels", None), ("xl/media/", None), ("xl/worksheets/sheet1.xml", None)]


@query("select * from (values " + ", ".join(f"('{n}', {'null' if k is None else repr(k)})" for n, k in _PARTS) + ") as t(name, kind)")
def package_part_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(n,) for n, _ in _PARTS], "name string")
    return names.select("name", formats.part_kind(F.col("name")).alias("kind"))


_NAMES = [("xl/a.xml", True), ("../a.xml", False), ("/a.xml", False), ("a\\b.xml", False), ("c:a.xml", False), ("a/./b.xml", False), ("a//b.xml", False), ("con.xml", False), ("xl/LPT1", False), ("a ", False), ("a./b", False), ("console.xml", True)]


@query("select * from (values " + ", ".join(f"('{n}', {str(k).lower()})" for n, k in _NAMES) + ") as t(name, safe)")
def safe_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n, _ in _NAMES], "name string").select("name", formats.is_safe_member(F.col("name")).alias("safe"))


# Maps


@query("""with m as (select c_custkey as k, c_name as v, concat('C_', cast(c_custkey % 1000 as varchar)) as a from customer)
    select 'identity' as side, (select count(*) from (select v from m group by v having count(distinct a) > 1)) as n
    union all select 'key', (select count(*) from (select a from m group by a having count(distinct v) > 1))""")
def map_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that would stand for several values."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("C_"), (F.col("c_custkey") % 1000).cast("string")).alias("alias"), F.col("c_name").alias("real_value"), F.lit("company").alias("entity_type"), F.lit(None).cast("string").alias("parent_alias"))
    return maps.conflicts(c, _entities(spark), "entity")


@query("select 'key' as side, count(*) as n from (select o_custkey from orders group by o_custkey having count(distinct o_orderkey) > 1)")
def provenance_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates that would hold several tokens; the same token at several coordinates is fine."""
    p = table(spark, sf_dir, "orders").select(F.lit("j").alias("job_id"), F.lit("s").alias("sheet_name"), F.col("o_custkey").cast("long").alias("row"), F.lit(1).alias("column"), F.concat(F.lit("INN_"), F.col("o_orderkey").cast("string")).alias("token"), F.lit("string").alias("representation"))
    return maps.conflicts(p, maps.empty(spark, maps.PROVENANCE), "provenance")


@query("select c_custkey as seq, c_name as real_value from customer")
def map_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insertion numbers follow the first place at which a value is seen."""
    s = _customers(spark, sf_dir)
    first = table(spark, sf_dir, "customer").agg(F.min("c_custkey")).first()[0]
    m = extend_entity_map(_entities(spark), [s])
    return m.select((F.col("seq") + (first - 1)).alias("seq"), "real_value")


@query("""select * from (values ('a', 'consistent'), ('b', 'store_missing'), ('c', 'store_regressed'), ('d', 'store_diverged'), ('e', 'ahead'), ('f', 'store_unexpected_entries'), ('g', 'store_ahead_unmarked'), ('h', 'store_diverged')) as t(name, state)""")
def store_sync_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("a", 5, True, 5, True, False), ("b", 5, False, 0, False, False), ("c", 5, True, 4, False, False), ("d", 5, True, 5, False, False), ("e", 5, True, 7, True, True), ("f", 0, True, 2, True, False), ("g", 5, True, 7, True, False), ("h", 5, True, 7, False, True)]
    return registry.sync_state(spark.createDataFrame(rows, "name string, entry_count long, present boolean, actual_count long, prefix_equal boolean, pending boolean"))


# Registry


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of orders: one monthly artifact each, a chain of canonical ones, a restored one of every third; every 10th month is wrong in some way."""
    months = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("period")).distinct()
    m = months.withColumn("n", (F.substring("period", 1, 4).cast("int") * 12 + F.substring("period", 6, 2).cast("int")).cast("long"))
    before = m.select((F.col("n") + 1).alias("n"), F.col("period").alias("before"))
    m = m.join(before, "n", "left")
    null = F.lit(None).cast("string")

    def rows(src, seq, lead, kind, parents, period="period"):
        return src.select(seq.alias("seq"), F.concat(F.lit(lead), F.col("period")).alias("artifact_id"), F.lit(kind).alias("kind"), F.sha2(F.concat(F.lit(lead), F.col("period")), 256).alias("sha256"), F.lit("2024-01-01T00:00:00Z").alias("created_at"), parents.alias("parent_artifact_ids"), F.col(period).alias("period"), null.alias("label"), null.alias("source_job_id"), null.alias("provenance_id"), null.alias("provenance_sha256"))

    name = lambda lead, c="period": F.concat(F.lit(lead), F.col(c))
    empty = F.array().cast("array<string>")
    monthly = rows(m, F.col("n") * 10, "m", "anonymized_monthly", F.when(F.col("n") % 10 == 3, F.array(name("m"))).otherwise(empty))
    chain = rows(m, F.col("n") * 10 + 1, "c", "analytical_canonical", F.when(F.col("before").isNull(), F.array(name("m"))).when(F.col("n") % 10 == 5, F.array(name("m"), name("c", "before"))).otherwise(F.array(name("c", "before"), name("m"))))
    restored = rows(m.where("n % 3 = 0"), F.when(F.col("n") % 10 == 6, F.col("n") * 10 - 5).otherwise(F.col("n") * 10 + 2), "r", "local_restored", F.array(name("c")))
    late = rows(m.where("n % 10 = 8 and before is not null"), F.col("n") * 10 + 3, "x", "local_restored", F.array(name("c", "before")))
    return monthly.unionByName(chain).unionByName(restored).unionByName(late)


_MONTHS = "(select distinct strftime(o_orderdate, '%Y-%m') as period, cast(strftime(o_orderdate, '%Y') as int) * 12 + cast(strftime(o_orderdate, '%m') as int) as n from orders)"


@query(f"""with m as (select * from {_MONTHS}), b as (select m.*, p.period as before from m left join m p on p.n + 1 = m.n)
    select concat('m', period) as artifact_id, 'unknown_parent' as reason from b where n % 10 = 3
    union all select concat('c', period), 'parent_kinds' from b where n % 10 = 5 and before is not null
    union all select concat('r', period), 'unknown_parent' from b where n % 3 = 0 and n % 10 = 6
    union all select concat('x', period), 'period' from b where n % 10 = 8 and before is not null""")
def artifact_lineage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.lineage_problems(_artifacts(spark, sf_dir))


@query(f"""with m as (select * from {_MONTHS})
    select count(*) as n_registered, count(*) filter (n % 4 > 1) as n_verified, count(*) filter (n % 4 = 0) as n_missing, count(*) filter (n % 4 = 1) as n_mismatched, cast(2 as bigint) as n_orphans from m""")
def artifact_file_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 4th file is missing, every 4th is changed, and two belong to nothing."""
    a = _artifacts(spark, sf_dir).where("kind = 'anonymized_monthly'")
    n = F.floor(F.col("seq") / 10)
    files = a.where(n % 4 != 0).select("artifact_id", F.when(n % 4 == 1, "changed").otherwise(F.col("sha256")).alias("file_sha256"))
    return registry.audit(a, files.union(spark.createDataFrame([("o1", "x"), ("o2", "y")], files.schema)))


@query(f"select concat('m', period) as artifact_id from {_MONTHS} where period = '1995-03'")
def artifact_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.listing(_artifacts(spark, sf_dir), "anonymized_monthly", "1995-03").select("artifact_id")


@query("""with b as (select cast(n as int) as revision, concat(lpad(cast(n as varchar), 8, '0'), '-', lpad(cast(n * 7 % 10 as varchar), 8, '0')) as name from range(1, 13) t(n) union all select 12, '00000012-ffffffff')
    select revision, name, row_number() over (order by revision desc, name desc) <= 5 as keep from b""")
def backup_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, f"{n:08d}-{n * 7 % 10:08d}") for n in range(1, 13)] + [(12, "00000012-ffffffff")]
    return registry.retention(spark.createDataFrame(rows, "revision int, name string"))


_FORMATS = [("2024-07", "period", True), ("2024-13", "period", False), ("2024-07-01T00:00:00Z", "timestamp", True), ("2024-02-30T00:00:00Z", "timestamp", False), ("0" * 32, "hex32", True), ("G" * 32, "hex32", False), ("a" * 64, "hex64", True), ("a" * 63, "hex64", False), ("x", "label", True), (" x", "label", False), ("y" * 65, "label", False)]


@query("select * from (values " + ", ".join(f"('{v}', '{k}', {str(o).lower()})" for v, k, o in _FORMATS) + ") as t(value, kind, fits)")
def format_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {"period": formats.is_period, "timestamp": formats.is_timestamp, "hex32": formats.is_hex32, "hex64": formats.is_hex64, "label": formats.is_label}
    fits = F.lit(None).cast("boolean")
    for kind, check in checks.items():
        fits = F.when(F.col("kind") == kind, check(F.col("value"))).otherwise(fits)
    return spark.createDataFrame([(v, k) for v, k, _ in _FORMATS], "value string, kind string").withColumn("fits", fits)


# Tables


@query("select n_nationkey + 2 as row_number, n_name as name, cast(n_regionkey as varchar) as region from nation")
def long_form_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide table to cells and back."""
    t = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 2).alias("row"), F.col("n_name").alias(place(1)), F.col("n_regionkey").alias(place(2)))
    return to_wide(to_cells(t, ["name", "region"]), 2).select(F.col("row").alias("row_number"), F.col(place(1)).alias("name"), F.col(place(2)).alias("region"))


@query("select kind, count(*) as n from (select case when n_nationkey % 2 = 0 then 'str' else 'null' end as kind from nation union all select 'int' from nation union all select 'str' from range(2)) group by kind")
def dense_rectangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a sheet's rectangle, blanks included."""
    t = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 2).alias("row"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias(place(1)), F.col("n_regionkey").alias(place(2)))
    cells = to_cells(t, ["name", "region"])
    sheets = cells.groupBy("sheet_index").agg(F.first("sheet_name").alias("title"), F.max("row").alias("max_row"), F.max("column").alias("max_column"))
    return dense(cells, sheets).groupBy("kind").agg(F.count("*").alias("n"))


@query("""select reason, count(*) as n from (
    select case when n_nationkey % 5 = 1 then 'duplicate_coordinate' when n_nationkey >= 20 then 'out_of_bounds' end as reason from nation) where reason is not null group by reason""")
def sink_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that can't be written into their workbook."""
    t = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("row"), F.col("n_name").alias(place(1)))
    cells = to_cells(t, ["n"]).where("s <> 'n'")
    cells = cells.union(cells.where("(row - 1) % 5 = 1"))
    sheets = spark.createDataFrame([(1, "Sheet1", "visible", 20, 1)], "sheet_index int, title string, state string, max_row int, max_column int")
    return sink_problems(cells, sheets).groupBy("reason").agg(F.count("*").alias("n"))


@query()
def package_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and counters of packages' parts, checked for many packages at once."""
    parts = table(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("package"), F.concat(F.lit("xl/p"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 17 == 0, "/../x").otherwise("")).alias("name"), F.length("html").cast("long").alias("bytes"), (F.length("html") / 4 + 1).cast("long").alias("compressed"))
    return scrub.package_counters(parts, ["package"]).join(scrub.name_problems(parts, ["package"]).where("reason = 'unsafe_name'").select("package", F.col("n").alias("n_unsafe")), "package", "left")


SQL["package_preflight"] = """select p as package, count(*) as n_entries, cast(sum(b) as bigint) as total_bytes, max(b / c) as max_ratio, nullif(count(*) filter (page_id % 17 = 0), 0) as n_unsafe
    from (select page_id, page_id % 10 as p, length(html) as b, cast(floor(length(html) / 4 + 1) as bigint) as c from pages) group by p"""


@query("select count(*) as n_rows, count(distinct n_name) as n_names, cast(2 as bigint) as n_sheets from nation")
def xlsx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook written, published and read by Spark."""
    from ..sources.xlsx import new_package, publish, read_package

    names = [r["n_name"] for r in table(spark, sf_dir, "nation").select("n_name").orderBy("n_nationkey").collect()]
    with tempfile.TemporaryDirectory() as folder:
        publish(new_package({"nation": [["name"], *([n] for n in names)], "more": [[1, 2.5, True]]}).save(), f"{folder}/n.xlsx")
        cells = store(read_package(spark, f"file://{folder}/n.xlsx", "cells").drop("path"), "xlsx")
        sheets = store(read_package(spark, f"file://{folder}/n.xlsx", "sheets").drop("path"), "xlsx")
    body = cells.where("sheet_name = 'nation' and row > 1").agg(F.count("*").alias("n_rows"), F.countDistinct("s").alias("n_names"))
    return body.join(sheets.agg(F.count("*").alias("n_sheets")))


@query("""select cast(3 as bigint) as n_entries, 'consistent' as mapping, 'consistent' as identifier, 'append_only_violation' as refused,
    sha256(unhex('0000000000000021' || hex('cloakframe/StoreDigest/v1/mapping') || '0000000000000003' || sha256(unhex(string_agg('000000000000000B' || hex('C_00000000' || i), '' order by i))))) as digest
    from range(1, 4) t(i)""")
def workspace_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workspace made, extended, refused a changed map, recovered and read again."""
    from ..operators.workspace import Workspace
    from ..types import WorkspaceError

    def entries(values):
        return spark.createDataFrame([(i, f"C_{i:09d}", v, "company", None) for i, v in enumerate(values, 1)], maps.ENTITY_MAP)

    with tempfile.TemporaryDirectory() as folder:
        ws = Workspace.create(spark, os.path.join(folder, "ws"), "long enough")
        with ws.mutation() as s:
            s.mapping = entries(["a", "b"])
        refused = None
        try:
            with ws.mutation() as s:
                s.mapping = spark.createDataFrame([(1, "C_999999999", "z", "company", None), (2, "C_000000002", "b", "company", None)], maps.ENTITY_MAP)
        except WorkspaceError as e:
            refused = e.reason
        ws.recover()
        with ws.mutation() as s:
            s.mapping = entries(["a", "b", "c"])
        state, m = ws.diagnose(), ws.manifest()
    return spark.createDataFrame([(m.mapping.entry_count, state["mapping"], state["identifier"], refused, m.mapping.prefix_digest)], "n_entries long, mapping string, identifier string, refused string, digest string")


# Whole jobs


def _workbook(spark: SparkSession, sf_dir: str):
    """Nations as a workbook as other programs write it: shared strings, and the same names again in a comment, a chart, a defined name, a property and a sheet of notes."""
    from ..sources.xlsx import new_package, published, with_property

    rows = [(r["n_name"], r["inn"], r["n_regionkey"]) for r in table(spark, sf_dir, "nation").selectExpr("n_name", f"{_inn10('n_nationkey')} as inn", "n_regionkey", "n_nationkey").orderBy("n_nationkey").collect()]
    names = "".join(f"<t>{n}</t>" for n, _, _ in rows)
    p = published(new_package({"Data": [["Компания", "ИНН", "Выручка"], *map(list, rows)], "Notes": [[n] for n, _, _ in rows], "More": [["Компания"], [rows[0][0]]]}))
    rels = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    p.parts["xl/comments1.xml"] = f'<comments xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><commentList><comment ref="A2"><text>{names}</text></comment></commentList></comments>'.encode()
    p.parts["xl/charts/chart1.xml"] = f"<chart>{names}</chart>".encode()
    p.parts["xl/worksheets/_rels/sheet1.xml.rels"] = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rels}/comments" Target="../comments1.xml"/><Relationship Id="rId2" Type="{rels}/chart" Target="../charts/chart1.xml"/></Relationships>'.encode()
    p.parts["xl/workbook.xml"] = p.parts["xl/workbook.xml"].replace(b"</sheets>", f'</sheets><definedNames><definedName name="x">"{rows[0][0]}"</definedName></definedNames>'.encode())
    return with_property(p, "Author", rows[1][0]), [n for n, _, _ in rows], [i for _, i, _ in rows]


_BOOK_RULES = {"Data": {1: rule("company", "pseudonymize", "Компания"), 2: rule("inn", "pseudonymize", "ИНН"), 3: rule("financial", "keep", "Выручка")}, "More": {1: rule("company", "pseudonymize", "Компания")}}
_BOOK_POLICIES = {"Data": "process", "More": "process", "Notes": "remove_all"}


def _anonymized_book(spark: SparkSession, sf_dir: str, folder: str):
    """The workbook and its anonymized copy in a folder, what the job returned, and the originals."""
    from ..sources.xlsx import publish
    from . import jobs

    p, names, inns = _workbook(spark, sf_dir)
    publish(p.save(), f"{folder}/in.xlsx")
    done = jobs.anonymize_workbook(spark, f"{folder}/in.xlsx", f"{folder}/out.xlsx", _BOOK_RULES, _entities(spark), identifier_map=_tokens(spark), policies=_BOOK_POLICIES)
    return done, names, inns


def _loaded(path: str):
    from ..sources.xlsx import Package

    with open(path, "rb") as f:
        return Package.load(f.read())


@query("""select count(*) as n_originals, true as in_source, cast(0 as bigint) as n_leaks, cast(0 as bigint) as n_unlisted_parts
    from (select n_name from nation union all select cast(n_nationkey as varchar) from nation)""")
def workbook_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many originals are in any part of an anonymized workbook."""
    with tempfile.TemporaryDirectory() as folder:
        _, names, inns = _anonymized_book(spark, sf_dir, folder)
        whole = lambda p: b"\n".join([*p.parts.values(), *(n.encode() for n in p.parts)])
        source, out = _loaded(f"{folder}/in.xlsx"), _loaded(f"{folder}/out.xlsx")
    kinds = ("[Content_Types].xml", "_rels/.rels", "docProps/custom.xml", "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/styles.xml", "xl/sharedStrings.xml", "xl/worksheets/sheet1.xml", "xl/worksheets/sheet2.xml")
    row = (len(names) + len(inns), all(n.encode() in whole(source) for n in [*names, *inns]), sum(n.encode() in whole(out) for n in [*names, *inns]), len(set(out.parts) - set(kinds)))
    return spark.createDataFrame([row], "n_originals long, in_source boolean, n_leaks long, n_unlisted_parts long")


@query("select * from (values (1, 'Data'), (2, 'More')) as t(sheet_index, title)")
def remove_all_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheets of an anonymized workbook, one of which was to be removed."""
    with tempfile.TemporaryDirectory() as folder:
        _anonymized_book(spark, sf_dir, folder)
        out = _loaded(f"{folder}/out.xlsx")
    return spark.createDataFrame([(i, s.title) for i, s in enumerate(out.sheets, 1)], "sheet_index int, title string")


@query(f"select n_nationkey + 2 as row_number, n_name as name, {_inn10('n_nationkey')} as inn, n_regionkey as amount from nation")
def workbook_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook anonymized, restored by its coordinates, and read by Spark."""
    from ..sources.xlsx import read_package
    from . import jobs

    with tempfile.TemporaryDirectory() as folder:
        done, _, _ = _anonymized_book(spark, sf_dir, folder)
        jobs.restore_workbook(spark, f"{folder}/out.xlsx", f"{folder}/back.xlsx", done.provenance, done.entity_map, done.identifier_map)
        cells = store(read_package(spark, f"file://{folder}/back.xlsx", "cells").drop("path"), "restored")
    body = cells.where("sheet_name = 'Data' and row > 1").groupBy(F.col("row").alias("row_number"))
    return body.agg(F.max(F.when(F.col("column") == 1, F.col("s"))).alias("name"), F.max(F.when(F.col("column") == 2, F.col("s"))).alias("inn"), F.max(F.when(F.col("column") == 3, F.col("i"))).cast("long").alias("amount"))


@query("select n_name as name, count(*) as n_customers from customer join nation on c_nationkey = n_nationkey group by n_name")
def analytical_workbook_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook of sums by alias, restored by value."""
    from ..sources.xlsx import new_package, publish, read_package
    from . import jobs

    with tempfile.TemporaryDirectory() as folder:
        done, names, _ = _anonymized_book(spark, sf_dir, folder)
        alias = {r["real_value"]: r["alias"] for r in done.entity_map.collect()}
        counts = {r["c_nationkey"]: r["count"] for r in table(spark, sf_dir, "customer").groupBy("c_nationkey").count().collect()}
        publish(new_package({"Sums": [["who", "n"], *([alias[n], counts[k]] for k, n in enumerate(names) if k in counts)]}).save(), f"{folder}/sums.xlsx")
        jobs.restore_analytical_workbook(spark, f"{folder}/sums.xlsx", f"{folder}/named.xlsx", done.entity_map, done.identifier_map)
        cells = store(read_package(spark, f"file://{folder}/named.xlsx", "cells").drop("path"), "named")
    body = cells.where("row > 1").groupBy("row").agg(F.max("s").alias("name"), F.max("i").cast("long").alias("n_customers"))
    return body.select("name", "n_customers")


@query("""select cast(2 as bigint) as n_files, (select count(distinct n) from (select n_name as n from nation union select s_name from supplier)) as n_entities, cast(1 as bigint) as n_shared, true as job_ids_differ""")
def workbooks_share_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two workbooks in one job: a value has one alias in both."""
    from ..sources.xlsx import new_package, publish
    from . import jobs

    nations = [r["n_name"] for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    suppliers = [r["s_name"] for r in table(spark, sf_dir, "supplier").select("s_name").orderBy("s_suppkey").collect()]
    rules = {"S": {1: rule("company", "pseudonymize")}}
    with tempfile.TemporaryDirectory() as folder:
        for n, values in (("a", nations), ("b", [*suppliers, nations[0]])):
            publish(new_package({"S": [["name"], *([v] for v in values)]}).save(), f"{folder}/{n}.xlsx")
        done = jobs.anonymize_workbooks(spark, [jobs.Item(f"{folder}/{n}.xlsx", f"{folder}/{n}-out.xlsx", rules) for n in "ab"], _entities(spark))
        values = [{c["s"] for c in _loaded(f"{folder}/{n}-out.xlsx").cells() if c["row"] > 1} for n in "ab"]
    return spark.createDataFrame([(len(values), done.entity_map.count(), len(values[0] & values[1]), len(set(done.job_ids)) == 2)], "n_files long, n_entities long, n_shared long, job_ids_differ boolean")


@query("""select * from (values ('cross_type_identifier_detected', 'kept value'), ('formula_rejected', 'formula'), ('header_mismatch', 'header'), ('missing_worksheet_policy', 'no policy'), ('passed', 'fine')) as t(outcome, case_name)""")
def gate_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate says to one workbook as it is and with one thing wrong at a time."""
    from ..operators.scrub import package_tables
    from ..sources.xlsx import new_package
    from ..types import EngineError

    head, row = ["Компания", "Выручка"], ["x", 5]
    rules = {"S": {1: rule("company", "pseudonymize", head[0]), 2: rule("financial", "keep", head[1])}}
    cases = {"fine": ([head, row], {"S": "process"}), "no policy": ([head, row], {}), "header": ([["компания", head[1]], row], {"S": "process"}), "formula": ([head, ["x", "=1"]], {"S": "process"}), "kept value": ([head, ["x", 770701001]], {"S": "process"})}
    out = []
    for name, (rows, policies) in cases.items():
        t = package_tables(spark, new_package({"S": rows}))
        try:
            policy.gate(t["cells"], t["sheets"], spark.createDataFrame(list(policies.items()), policy.POLICIES), policy.rules_table(spark, rules))
            out.append((name, "passed"))
        except EngineError as e:
            out.append((name, e.reason))
    return spark.createDataFrame(out, "case_name string, outcome string")


@query("""select 'known_entity_value_present' as with_names, cast(0 as bigint) as n_left_of_names, cast(0 as bigint) as n_grammar_problems, true as hash_holds, false as exists_after""")
def external_candidate_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scrubbed copy for outsiders: refused while known values are in it, clean and hashed otherwise, gone afterwards."""
    from hashlib import sha256

    from ..operators import grammar
    from ..types import PackageError

    with tempfile.TemporaryDirectory() as folder:
        done, names, _ = _anonymized_book(spark, sf_dir, folder)
        data = {n: open(f"{folder}/{n}.xlsx", "rb").read() for n in ("in", "out")}
        refused = None
        try:
            with scrub.external_candidate(spark, data["in"], done.entity_map, done.identifier_map):
                pass
        except PackageError as e:
            refused = e.reason
        with scrub.external_candidate(spark, data["out"], done.entity_map, done.identifier_map) as (path, digest):
            with open(path, "rb") as f:
                clean = f.read()
            parts = _loaded(path).parts
        bad = grammar.problems(grammar.nodes_of(spark, parts)).count()
        row = (refused, sum(n.encode() in b"".join(parts.values()) for n in names), bad, sha256(clean).hexdigest() == digest, os.path.exists(path))
    return spark.createDataFrame([row], "with_names string, n_left_of_names long, n_grammar_problems long, hash_holds boolean, exists_after boolean")


@query("""select * from (values ('xl/styles.xml', 'xf', 'fontId', 'invalid_value'), ('xl/workbook.xml', 'definedNames', null, 'unknown_element'), ('xl/workbook.xml', 'definedName', null, 'unknown_element'),
    ('xl/workbook.xml', 'definedName', 'name', 'unknown_attribute'), ('xl/workbook.xml', 'sheet', 'sheetId', 'missing_attribute'), ('xl/workbook.xml', 'sheet', 'name', 'repeated_title'),
    ('xl/worksheets/sheet1.xml', 'c', 'cm', 'unknown_attribute'), ('xl/worksheets/sheet1.xml', 'c', 'r', 'invalid_value'), ('xl/worksheets/sheet1.xml', 'legacyDrawing', null, 'unknown_element'),
    ('xl/worksheets/sheet1.xml', 'mergeCells', 'count', 'uncounted'), ('xl/sharedStrings.xml', '', null, 'malformed'), ('xl/_rels/workbook.xml.rels', 'Relationship', 'Id', 'repeated_relationship')) as t(part, element, attribute, reason)""")
def scrub_grammar_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package with one thing wrong of each sort."""
    from ..operators import grammar

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    parts = {
        "xl/workbook.xml": f'<workbook {main}><sheets><sheet name="A" sheetId="1" r:id="rId1"/><sheet name="a" r:id="rId2"/></sheets><definedNames><definedName name="x">1</definedName></definedNames></workbook>',
        "xl/worksheets/sheet1.xml": f'<worksheet {main}><sheetData><row r="1"><c r="A1" cm="1"><v>1</v></c><c r="1A"/></row></sheetData><mergeCells count="2"><mergeCell ref="A1:B1"/></mergeCells><legacyDrawing/></worksheet>',
        "xl/styles.xml": f'<styleSheet {main}><cellXfs count="1"><xf numFmtId="0" fontId="one"/></cellXfs></styleSheet>',
        "xl/sharedStrings.xml": "<sst",
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="t" Target="a"/><Relationship Id="rId1" Type="t" Target="b"/></Relationships>',
    }
    found = grammar.problems(grammar.nodes_of(spark, {n: d.encode() for n, d in parts.items()}))
    return found.select("part", "element", "attribute", "reason")


_SHAPES = [("bool", "1", True), ("bool", "yes", False), ("int", "-12", True), ("int", "1.5", False), ("float", "1.50", True), ("float", "1.", False), ("cell", "$B$12", True), ("cell", "ABCD1", False), ("range", "A1:C3", True), ("range", "A1:", False), ("ranges", "A1 B2:C3", True), ("ranges", "A1,B2", False), ("rgb", "FF00aa11", True), ("rgb", "red", False), ("measure", "2.5mm", True), ("measure", "2.5", False), ("tint", "-0.25", True), ("tint", "1.5", False), ("scientific", "4.9E-3", True), ("scientific", "e5", False), ("unit", "0.5", True), ("unit", "-0.1", False), ("line", "thin", True), ("line", "wavy", False), ("title", "Sheet 1", True), ("title", "a/b", False)]


@query("select * from (values " + ", ".join(f"('{s}', '{v}', {str(o).lower()})" for s, v, o in _SHAPES) + ") as t(shape, value, fits)")
def attribute_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.grammar import SHAPES

    t = spark.createDataFrame([(s, v) for s, v, _ in _SHAPES], "shape string, value string")
    fits = F.lit(None).cast("boolean")
    for name, check in SHAPES.items():
        fits = F.when(F.col("shape") == name, check(F.col("value"))).otherwise(fits)
    return t.withColumn("fits", fits)


@query("""select (select count(distinct c_name) from customer) as n_found, cast(0 as bigint) as n_wrong, 'ambiguous_value' as without_type, true as nothing_unknown, (select c_name from customer order by c_custkey limit 1) as by_alias""")
def map_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities and identifiers looked up one at a time and all at once."""
    from ..types import AmbiguousMappingError

    m = store(extend_entity_map(_entities(spark), [_customers(spark, sf_dir)]), "lookups")
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("real_value")).distinct()
    both = names.join(m, "real_value")
    first = table(spark, sf_dir, "customer").orderBy("c_custkey").first()["c_name"]
    alias = maps.lookup_alias(m, first, "company")
    wrong = both.where(~F.col("alias").startswith("C_")).count() + (m.where(F.col("alias") == alias).first()["real_value"] != first)
    one = m.where(F.col("alias") == alias)  # a limit would take another row each time it is read
    twice = one.unionByName(one.withColumn("alias", F.lit("P_000000000")).withColumn("entity_type", F.lit("person")))
    reason = None
    try:
        maps.lookup_alias(twice, first)
    except AmbiguousMappingError as e:
        reason = e.reason
    none = maps.lookup_alias(m, "nobody") is None and maps.lookup_token(_tokens(spark), "inn", "1") is None
    return spark.createDataFrame([(both.count(), wrong, reason, none, m.where(F.col("alias") == alias).first()["real_value"])], "n_found long, n_wrong long, without_type string, nothing_unknown boolean, by_alias string")


@query("""select (select count(distinct n_name) from nation) as n_entries, true as equal, cast(0 as bigint) as n_files_with_originals, 'wrong_password_or_changed' as wrong_password""")
def sealed_store_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workspace's map, opened again by its password; no file of the workspace or of the scratch folder holds an original."""
    from ..operators.workspace import Workspace
    from ..sources.tables import scratch
    from ..types import CryptoError

    names = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 2).alias("row"), F.col("n_name").alias(place(1)))
    values = [r[1].encode() for r in names.collect()]
    with tempfile.TemporaryDirectory() as folder:
        ws = Workspace.create(spark, f"{folder}/ws", "long enough")
        with ws.mutation() as s:
            s.mapping = extend_entity_map(s.mapping, [Sheet("n", names, {1: rule("company", "pseudonymize")})])
        again = Workspace.open(spark, f"{folder}/ws", "long enough").read("mapping")
        n, equal = again.count(), again.select("real_value").exceptAll(names.select(place(1))).isEmpty()
        places = [f"{folder}/ws"] + ([scratch(spark).removeprefix("file://")] if scratch(spark).startswith("file://") else [])
        leaks = 0
        for top in places:
            for d, _, files in os.walk(top):
                for f in files:
                    if "map" in d or "keys" in d or "stores" in d or "numbering" in d or "additions" in d:
                        with open(os.path.join(d, f), "rb") as x:
                            content = x.read()
                        leaks += any(v in content for v in values if len(v) > 5)
        reason = None
        try:
            Workspace.open(spark, f"{folder}/ws", "something else")
        except CryptoError as e:
            reason = e.reason
    return spark.createDataFrame([(n, equal, leaks, reason)], "n_entries long, equal boolean, n_files_with_originals long, wrong_password string")


@query("""select 'mutation_pending' as refused, cast(2 as bigint) as n_recovered, cast(1 as bigint) as n_registered, cast(1 as bigint) as n_verified, cast(0 as bigint) as n_mismatched, cast(1 as bigint) as n_orphans, 'artifact_changed' as after_change,
    cast(2 as bigint) as n_backups, 'consistent' as backup_state""")
def workspace_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mutation that broke off and was recovered; artifacts registered, audited and changed; backups kept and checked."""
    from ..operators.workspace import Workspace
    from ..sources.xlsx import new_package, publish
    from ..types import WorkspaceError

    def entries(*values):
        return spark.createDataFrame([(i, f"C_{i:09d}", v, "company", None) for i, v in enumerate(values, 1)], maps.ENTITY_MAP)

    def reason_of(f):
        try:
            f()
        except WorkspaceError as e:
            return e.reason
        return None

    def mutate():
        with ws.mutation():
            pass

    with tempfile.TemporaryDirectory() as folder:
        ws = Workspace.create(spark, f"{folder}/ws", "long enough")
        try:
            with ws.mutation() as s:
                s.mapping = entries("a")
                ws._write("mapping", entries("a", "b"), 2)
                raise RuntimeError
        except RuntimeError:
            pass
        refused = reason_of(mutate)
        recovered = ws.recover().mapping.entry_count
        i, path = ws.allocate()
        publish(new_package({"S": [[1]]}).save(), path)
        publish(new_package({"S": [[2]]}).save(), ws.allocate()[1])
        ws.register(i, "anonymized_monthly", "2024-07", findings=spark.createDataFrame([], inspect.FINDINGS))
        audit = ws.verify()
        for _ in range(3):
            newest = ws.snapshot(keep_last=2)
        backups, state = ws.backups().count(), ws.verify_backup(newest)["mapping"]
        publish(new_package({"S": [[3]]}).save(), path)
        changed = reason_of(lambda: ws.verified_path(i))
    row = (refused, recovered, audit["n_registered"], audit["n_verified"], audit["n_mismatched"], audit["n_orphans"], changed, backups, state)
    return spark.createDataFrame([row], "refused string, n_recovered long, n_registered long, n_verified long, n_mismatched long, n_orphans long, after_change string, n_backups long, backup_state string")
