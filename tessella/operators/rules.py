"""Rules: a registry of checks, each a function from tables to violations, and their reports.

A violation row is (rule, severity, entity, value, threshold). A rule that fails to run is reported as
such and does not stop the others.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import saved
from ..registry import query, table

#: Severities and their weights.
SEVERITIES = {"blocking": 4, "major": 3, "minor": 2, "info": 1}


@dataclass
class Rule:
    name: str
    family: str
    severity: str
    check: Callable[[SparkSession, str], tuple[DataFrame, Column, Column, Column]]


RULES: dict[str, Rule] = {}


def rule(name: str, family: str, severity: str):
    """Registers a check: it returns the rows tested, their entity, whether they are in order, and the measured value."""
    def add(f):
        RULES[name] = Rule(name, family, severity, f)
        return f

    return add


@rule("ref-customer", "reference", "blocking")
def ref_customer(spark: SparkSession, sf_dir: str):
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("known"))
    o = table(spark, sf_dir, "orders").join(keys, F.col("o_custkey") == F.col("known"), "left")
    return o, F.col("o_orderkey"), F.col("known").isNotNull(), F.col("o_custkey")


@rule("range-discount", "range", "major")
def range_discount(spark: SparkSession, sf_dir: str):
    v = F.round(F.col("l_discount") * 100).cast("long")
    return table(spark, sf_dir, "lineitem"), F.col("l_orderkey"), v.between(0, 9), v


@rule("range-quantity", "range", "minor")
def range_quantity(spark: SparkSession, sf_dir: str):
    v = F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem"), F.col("l_orderkey"), v <= 48, v


@rule("unique-line", "unique", "major")
def unique_line(spark: SparkSession, sf_dir: str):
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return g, F.col("l_orderkey"), F.col("n") == 1, F.col("n")


@rule("domain-status", "domain", "blocking")
def domain_status(spark: SparkSession, sf_dir: str):
    return table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_orderstatus").isin("O", "F", "P"), F.length("o_orderstatus").cast("long")


@rule("label-range", "domain", "info")
def label_range(spark: SparkSession, sf_dir: str):
    return table(spark, sf_dir, "labels"), F.col("doc_id"), ~((F.col("quality") == 0) & (F.col("toxic") == 1)), (F.col("quality") * 10 + F.col("toxic")).cast("long")


def results(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> DataFrame:
    """All tested rows of the rules that could be run: rule, family, severity, entity, ok, value.

    Each rule runs and is stored apart, so one that fails, in its plan or on a row, leaves a note and stops no other.
    """
    out = None
    for r in RULES.values():
        if names and r.name not in names:
            continue
        try:
            rows, entity, ok, value = r.check(spark, sf_dir)
            found = saved(rows.select(F.lit(r.name).alias("rule"), F.lit(r.family).alias("family"), F.lit(r.severity).alias("severity"), entity.cast("long").alias("entity"), F.coalesce(ok, F.lit(False)).alias("ok"), value.cast("long").alias("value")))
        except (PySparkException, Py4JError) as e:
            note = str(e).splitlines()[0][:60]
            found = spark.createDataFrame([(r.name, f"not run: {note}", r.severity, None, False, None)], "rule string, family string, severity string, entity long, ok boolean, value long")
        out = found if out is None else out.unionByName(found)
    return out


TESTED = """
t AS (SELECT 'ref-customer' AS rule, 'reference' AS family, 'blocking' AS severity, o_orderkey AS entity, EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey) AS ok, o_custkey AS value FROM orders
  UNION ALL SELECT 'range-discount', 'range', 'major', l_orderkey, CAST(round(l_discount * 100) AS BIGINT) BETWEEN 0 AND 9, CAST(round(l_discount * 100) AS BIGINT) FROM lineitem
  UNION ALL SELECT 'range-quantity', 'range', 'minor', l_orderkey, l_quantity <= 48, CAST(l_quantity AS BIGINT) FROM lineitem
  UNION ALL SELECT 'unique-line', 'unique', 'major', l_orderkey, count(*) = 1, count(*) FROM lineitem GROUP BY l_orderkey, l_linenumber
  UNION ALL SELECT 'domain-status', 'domain', 'blocking', o_orderkey, o_orderstatus IN ('O', 'F', 'P'), length(o_orderstatus) FROM orders
  UNION ALL SELECT 'label-range', 'domain', 'info', doc_id, NOT (quality = 0 AND toxic = 1), quality * 10 + toxic FROM labels)
"""


@query("a15_rule_tally", f"""
WITH {TESTED} SELECT coalesce(family, 'all') AS family, coalesce(rule, 'all') AS rule, count(*) AS tested, count(*) FILTER (WHERE ok) AS in_order, count(*) FILTER (WHERE ok)::DOUBLE / count(*) AS rate FROM t GROUP BY ROLLUP (family, rule)
""")
def rule_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir).rollup("family", "rule").agg(F.count(F.lit(1)).alias("tested"), F.count_if("ok").alias("in_order"))
    return r.select(F.coalesce("family", F.lit("all")).alias("family"), F.coalesce("rule", F.lit("all")).alias("rule"), "tested", "in_order", (F.col("in_order").cast("double") / F.col("tested")).alias("rate"))


@query("v01_violations", f"WITH {TESTED} SELECT rule, severity, entity, value FROM t WHERE NOT ok")
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).filter("NOT ok").select("rule", "severity", "entity", "value")


@query("v02_one_rule", f"WITH {TESTED} SELECT rule, count(*) AS tested, count(*) FILTER (WHERE NOT ok) AS violated FROM t WHERE rule = 'unique-line' GROUP BY rule")
def one_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir, ["unique-line"]).groupBy("rule").agg(F.count(F.lit(1)).alias("tested"), F.count_if(~F.col("ok")).alias("violated"))


def schema_errors(value, schema: dict, path: str = "$") -> list[str]:
    """Errors of a JSON value against a subset of JSON Schema: type, enum, bounds, pattern, required, properties, items, anyOf, allOf, not."""
    import re

    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
    errors = []
    if kind := schema.get("type"):
        named = [kind] if isinstance(kind, str) else kind
        fits = any(
            (isinstance(value, (int, float)) and not isinstance(value, bool)) if k == "number" else
            (isinstance(value, int) and not isinstance(value, bool)) if k == "integer" else isinstance(value, kinds[k]) for k in named
        )
        if not fits:
            return [f"{path}: not of type {'/'.join(named)}"]
    if "enum" in schema and value not in schema["enum"]:
        errors.append(f"{path}: not in the list")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            errors.append(f"{path}: below {schema['minimum']}")
        if value > schema.get("maximum", value):
            errors.append(f"{path}: above {schema['maximum']}")
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        errors.append(f"{path}: does not match the pattern")
    if isinstance(value, dict):
        errors += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, s in schema.get("properties", {}).items():
            if k in value:
                errors += schema_errors(value[k], s, f"{path}.{k}")
    if isinstance(value, list) and "items" in schema:
        for k, v in enumerate(value):
            errors += schema_errors(v, schema["items"], f"{path}[{k}]")
    if "anyOf" in schema and not any(not schema_errors(value, s, path) for s in schema["anyOf"]):
        errors.append(f"{path}: fits none of the choices")
    for s in schema.get("allOf", []):
        errors += schema_errors(value, s, path)
    if "not" in schema and not schema_errors(value, schema["not"], path):
        errors.append(f"{path}: fits what is excluded")
    return errors


@query("v03_json_schema", """
SELECT event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) > 90 THEN '$.k: above 90' ELSE '$.k: below 5' END AS error FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) NOT BETWEEN 5 AND 90
""")
def json_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's errors against a schema; text in, rows out, in Arrow batches."""
    schema = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 5, "maximum": 90}}}

    def run(batches):
        import pandas as pd

        for rows in batches:
            found = [(i, e) for i, text in zip(rows["event_id"].tolist(), rows["props"], strict=True) for e in schema_errors(json.loads(text), schema)]
            yield pd.DataFrame(found, columns=["event_id", "error"])

    return table(spark, sf_dir, "events").select("event_id", "props").mapInPandas(run, "event_id long, error string")


@query("v04_structure", """
WITH i AS (SELECT l_orderkey, l_linenumber, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS next FROM lineitem)
SELECT 'duplicate' AS fault, l_orderkey AS id, count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY l_orderkey
UNION ALL SELECT 'orphan', l_orderkey, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey
UNION ALL SELECT 'gap', l_orderkey, count(*) FROM i WHERE next > l_linenumber + 1 GROUP BY l_orderkey
""")
def structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique ids, known references and contiguous numbering."""
    li = table(spark, sf_dir, "lineitem")
    twice = li.groupBy("l_orderkey", "l_linenumber").count().filter("count > 1")
    orphan = li.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti")
    gap = li.withColumn("next", F.lead("l_linenumber").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))).filter("next > l_linenumber + 1")
    parts = [d.groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(f).alias("fault"), "id", "n") for f, d in (("duplicate", twice), ("orphan", orphan), ("gap", gap))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("v05_provenance_coverage", """
WITH p AS (SELECT event_type, unnest(['k', 'value', 'ts']) AS field, unnest([CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) > 10 THEN 'survey' END, CASE WHEN value > 5 THEN 'rule' END, 'source']) AS kind FROM events)
SELECT field, coalesce(kind, 'missing') AS kind, count(*) AS n FROM p GROUP BY 1, 2
""")
def provenance_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the values of each field come from, and how many say nothing."""
    k = F.get_json_object("props", "$.k").cast("long")
    prov = F.array(*[F.struct(F.lit(f).alias("field"), kind.alias("kind")) for f, kind in (("k", F.when(k > 10, "survey")), ("value", F.when(F.col("value") > 5, "rule")), ("ts", F.lit("source")))])
    p = table(spark, sf_dir, "events").select(F.inline(prov))
    return p.groupBy("field", F.coalesce("kind", F.lit("missing")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("v06_layer_consistency", """
SELECT n_nationkey, count(*) AS members, min(CAST(floor(c_acctbal) AS BIGINT)) < 0 OR max(CAST(floor(c_acctbal) AS BIGINT)) > 10000 AS out_of_range FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
""")
def layer_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey"))
    c = table(spark, sf_dir, "customer").withColumn("x", F.floor("c_acctbal"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("members"), ((F.min("x") < 0) | (F.max("x") > 10000)).alias("out_of_range"))


@query("v07_parameter_coherence", """
SELECT p_type, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total, sum(p_size) BETWEEN 20 * count(*) AND 30 * count(*) AS coherent FROM part GROUP BY p_type
""")
def parameter_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, total = F.count(F.lit(1)), F.sum("p_size")
    return table(spark, sf_dir, "part").groupBy("p_type").agg(n.alias("n"), total.alias("total"), total.between(20 * n, 30 * n).alias("coherent"))


@query("o04b_worst_violations", f"""
WITH {TESTED}, v AS (SELECT *, CASE severity WHEN 'blocking' THEN 4 WHEN 'major' THEN 3 WHEN 'minor' THEN 2 ELSE 1 END AS w FROM t WHERE NOT ok),
k AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY w DESC, value DESC, entity) AS n FROM v) SELECT rule, severity, entity, value FROM k WHERE n <= 3 ORDER BY w DESC, value DESC, entity, rule LIMIT 30
""")
def worst_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's thirty worst cases, three of a rule at most."""
    weight = F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv])[F.col("severity")]
    v = results(spark, sf_dir).filter("NOT ok").withColumn("w", weight)
    order = [F.col("w").desc(), F.col("value").desc(), F.col("entity")]
    k = v.withColumn("n", F.row_number().over(Window.partitionBy("rule").orderBy(*order))).filter("n <= 3")
    return k.orderBy(*order, "rule").limit(30).select("rule", "severity", "entity", "value")
