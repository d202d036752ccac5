"""Curation, audits, manifests, reviews and models over documents, orders and conversations."""
import json
from functools import reduce

from pyspark.sql import Column, Window, functions as F

from deltascope import vocab
from deltascope.operators import audits, curation, drift, facts, features, metrics, models, privacy, reviews, splits
from deltascope.queries import drift_queries as d
from deltascope.queries import tables as t
from deltascope.sources import manifests, reports

C = F.col
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def curated_records(spark, sf_dir):
    return t.curated(spark, sf_dir)


CUR = t.CURATED_SQL


# -- intake -----------------------------------------------------------------
@query(f"WITH {CUR} SELECT record_id, stage, quality_status, label_quality_tier, eligible AS eligible_for_supervised_training, array_to_string(list_concat(reasons, warnings), '; ') AS reasons FROM curated")
def intake_rules(spark, sf_dir):
    """Stage, quality, tier, eligibility and reasons of every record."""
    return curated_records(spark, sf_dir).select(
        "record_id", "stage", "quality_status", "label_quality_tier", "eligible_for_supervised_training",
        F.array_join(F.concat("reasons", "warnings"), "; ").alias("reasons"),
    )


@query(f"""WITH {CUR} SELECT count(*) AS imported, count(*) FILTER (WHERE stage = 'ACCEPTED') AS accepted, count(*) FILTER (WHERE stage = 'QUARANTINED') AS quarantined,
    count(*) FILTER (WHERE stage = 'EXCLUDED') AS excluded, count(*) FILTER (WHERE NOT is_controlled) AS real_record_count, count(*) FILTER (WHERE is_controlled) AS controlled_record_count,
    count(DISTINCT CASE WHEN stage = 'ACCEPTED' THEN extension_id END) AS unique_extension_count, count(*) FILTER (WHERE eligible) AS eligible_supervised_training_count FROM curated""")
def intake_summary(spark, sf_dir):
    return audits.intake_summary(curated_records(spark, sf_dir))


_DIMENSIONS = ["label", "label_source", "label_quality_tier", "license_status", "license", "source_type", "split", "functional_category", "stage"]


@query(f"WITH {CUR} " + " UNION ALL ".join(f"SELECT '{name}' AS dimension, coalesce(nullif({name}, ''), 'unknown') AS value, count(*) AS records, count(DISTINCT extension_id) AS extensions FROM curated GROUP BY 2" for name in _DIMENSIONS))
def dataset_distributions(spark, sf_dir):
    """Nine single-dimension distributions in one pass."""
    return audits.distributions(curated_records(spark, sf_dir), _DIMENSIONS)


@query("SELECT l.label, l.severity_order, l.allowed AS allowed_for_training, count(x.label) AS records FROM (VALUES " + ", ".join(f"('{k}', {o}, {str(a).lower()})" for k, (o, a) in vocab.LABELS.items()) + f") l(label, severity_order, allowed) LEFT JOIN (WITH {CUR} SELECT label FROM curated) x USING (label) GROUP BY 1, 2, 3")
def label_ontology(spark, sf_dir):
    """The label vocabulary with how often each label is used."""
    used = curated_records(spark, sf_dir).groupBy("label").agg(F.count("*").alias("records"))
    joined = curation.label_ontology(spark).join(used, "label", "left")
    return joined.select("label", "severity_order", "allowed_for_training", F.coalesce("records", F.lit(0)).alias("records"))


@query(f"""WITH {CUR} SELECT stage, count(*) AS records, count(*) FILTER (WHERE provenance_complete) AS intake_complete,
    count(*) FILTER (WHERE provenance_complete AND old_timestamp IS NOT NULL AND new_timestamp IS NOT NULL) AS dated_complete FROM curated GROUP BY 1""")
def provenance_completeness(spark, sf_dir):
    rows = curated_records(spark, sf_dir)
    dated = C("provenance_complete") & C("old_timestamp").isNotNull() & C("new_timestamp").isNotNull()
    return rows.groupBy("stage").agg(F.count("*").alias("records"), F.count_if("provenance_complete").alias("intake_complete"), F.count_if(dated).alias("dated_complete"))


_REQUIRED = ["extension_name", "label_rationale"]


@query(
    f"""WITH {CUR}, g AS (SELECT extension_id, count(DISTINCT CASE WHEN split <> 'controlled_holdout' THEN split END) AS s FROM curated GROUP BY 1)
    SELECT pair_id, array_to_string(list_filter([CASE WHEN extension_name IS NULL THEN 'missing extension_name' END, CASE WHEN label_rationale IS NULL THEN 'missing label_rationale' END,
      CASE WHEN label = 'odd label' THEN 'invalid label ''odd label''' END, CASE WHEN new_timestamp = 'not a time' THEN 'invalid timestamp' END,
      CASE WHEN ot > nt THEN 'old_timestamp is after new_timestamp' END, CASE WHEN s > 1 THEN 'extension_id appears in multiple experiment splits' END], lambda x: x IS NOT NULL), '; ') AS errors,
      CASE WHEN label = 'uncertain' THEN 'label ''uncertain'' must be excluded from supervised training' ELSE '' END AS warnings FROM curated JOIN g USING (extension_id)"""
)
def record_validation(spark, sf_dir):
    """Errors and warnings per record."""
    rows = t.records(spark, sf_dir).withColumns(
        {
            "old_archive_path": C("old_doc").cast("string"), "new_archive_path": C("new_doc").cast("string"), "source": C("source_reference"),
            "source_uri": C("source_reference"), "collection_timestamp": F.lit("2024-01-01"), "label_confidence": F.lit("high"),
        }
    )
    return curation.validate(rows).select("pair_id", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


@query(f"WITH {t.RECORDS_SQL} SELECT record_id, split FROM records WHERE note <> '{vocab.EXTERNAL_HOLDOUT_NOTE}'")
def holdout_exclusion(spark, sf_dir):
    """Records left when the external holdout is taken out."""
    rows = t.records(spark, sf_dir)
    return curation.without_holdout(rows, curation.external_holdout(rows)).select("record_id", "split")


@query(f"WITH {CUR} SELECT coalesce(split, 'all') AS split, count(*) AS records, count(*) FILTER (WHERE eligible) AS eligible, count(DISTINCT extension_id) AS extensions, count(*) FILTER (WHERE label = 'uncertain') AS uncertain, CAST(sum(CAST('0x' || substr(sha256(concat_ws(chr(31), record_id, extension_id, coalesce(label, ''), coalesce(split, ''))), 1, 15) AS BIGINT)) AS VARCHAR) AS content_sum FROM curated GROUP BY GROUPING SETS ((split), ())")
def dataset_snapshot(spark, sf_dir):
    """Counts and content hash per split and for all."""
    return curation.snapshot(curated_records(spark, sf_dir), ["record_id", "extension_id", "label", "split"])


@query(f"WITH {t.RECORDS_SQL} SELECT record_id, extension_id, label FROM records")
def merged_corpus(spark, sf_dir):
    """Previous corpus and new records as one table."""
    rows = t.records(spark, sf_dir)
    is_new = C("new_doc") % 2 == 0
    merged = curation.merge_records(rows.where(~is_new).drop("lang"), rows.where(is_new))
    return merged.select("record_id", "extension_id", "label")


# -- audits -----------------------------------------------------------------
_SIDES_SQL = "sides AS (SELECT pair_id, extension_id, 'old' AS side, old_sha256 AS sha, old_version AS v FROM records UNION ALL SELECT pair_id, extension_id, 'new', new_sha256, new_version FROM records)"
_REPEAT_SQL = _SIDES_SQL + """, repeats AS (SELECT sha AS sha256, count(*) AS uses, coalesce(count(*) = 2 AND count(*) FILTER (WHERE side = 'old') = 1 AND min(extension_id) = max(extension_id)
  AND min(v) FILTER (WHERE side = 'old') = min(v) FILTER (WHERE side = 'new'), false) AS adjacent_reuse FROM sides GROUP BY 1 HAVING count(*) > 1)"""


@query(f"WITH {t.RECORDS_SQL}, {_REPEAT_SQL} SELECT sha256, uses, adjacent_reuse FROM repeats")
def repeated_packages(spark, sf_dir):
    """Package hashes used more than once; the expected reuse of a chain is marked."""
    return audits.repeated_hashes(t.records(spark, sf_dir))


@query(f"WITH {t.RECORDS_SQL}, {_REPEAT_SQL} SELECT sha256, pair_id, side, adjacent_reuse FROM repeats JOIN sides ON sha = sha256 ")
def repeated_package_members(spark, sf_dir):
    """Every use of every repeated package."""
    return audits.repeated_hash_members(t.records(spark, sf_dir))


@query(f"""WITH {t.RECORDS_SQL}, {_REPEAT_SQL} SELECT CAST(0 AS BIGINT) AS duplicate_record_ids, (SELECT count(*) FROM (SELECT 1 FROM records GROUP BY extension_id, old_version, new_version HAVING count(*) > 1)) AS duplicate_pairs,
    count(*) FILTER (WHERE NOT adjacent_reuse) AS duplicate_package_hashes, count(*) FILTER (WHERE adjacent_reuse) AS adjacent_version_reuse, count(*) FILTER (WHERE NOT adjacent_reuse) = 0 AS passed FROM repeats""")
def duplicate_report(spark, sf_dir):
    return audits.duplicate_report(t.records(spark, sf_dir))


def _leak_sql(source: str, names: tuple[str, str, str]) -> str:
    group, digest, _ = names
    return f"""SELECT '{group}' AS type, extension_id AS key, string_agg(DISTINCT split, '|' ORDER BY split) AS splits FROM {source} GROUP BY 2 HAVING count(DISTINCT split) > 1
    UNION ALL SELECT '{digest}', sha, string_agg(DISTINCT split, '|' ORDER BY split) FROM (SELECT split, old_sha256 AS sha FROM {source} UNION ALL SELECT split, new_sha256 FROM {source}) GROUP BY 2 HAVING count(DISTINCT split) > 1"""


@query(f"WITH {t.RECORDS_SQL} {_leak_sql('records', ('extension_group', 'package_hash', ''))} UNION ALL SELECT 'controlled_mutation_family', extension_id || ':mutation', string_agg(DISTINCT split, '|' ORDER BY split) FROM records WHERE controlled_mutation_type IS NOT NULL GROUP BY 2 HAVING count(DISTINCT split) > 1")
def split_leakage(spark, sf_dir):
    """Extensions, packages and mutation families that span splits."""
    found = audits.split_leakage(t.records(spark, sf_dir))
    return found.withColumn("splits", F.array_join("splits", "|"))


@query(f"WITH {CUR}, e AS (SELECT * FROM curated WHERE eligible) {_leak_sql('e', ('extension_overlap', 'package_hash_overlap', ''))} UNION ALL SELECT 'duplicate_transition_pairs', old_sha256 || '->' || new_sha256, string_agg(DISTINCT split, '|' ORDER BY split) FROM e GROUP BY 2 HAVING count(*) > 1")
def group_split_audit(spark, sf_dir):
    """Overlap among eligible records joined to their provenance."""
    rows = curated_records(spark, sf_dir).where("eligible_for_supervised_training")
    found = audits.group_split_audit(rows, t.records(spark, sf_dir))
    return found.withColumn("splits", F.array_join("splits", "|"))


@query(
    f"WITH {CUR}, q AS (SELECT " + ", ".join(
        f"count(*) FILTER (WHERE split = '{s}') AS {s}_records, count(DISTINCT extension_id) FILTER (WHERE split = '{s}') AS {s}_extensions, count(DISTINCT label) FILTER (WHERE split = '{s}' AND eligible) AS {s}_eligible_labels, count(*) FILTER (WHERE split = '{s}' AND controlled_mutation_type IS NULL) AS {s}_real, count(*) FILTER (WHERE split = '{s}' AND controlled_mutation_type IS NOT NULL) AS {s}_controlled"
        for s in vocab.SPLITS
    ) + """ FROM curated), z AS (SELECT count(*) AS unique_extensions, min(n) AS min_pairs, max(n) AS max_pairs, CAST(median(n) AS DOUBLE) AS median_pairs FROM (SELECT count(*) AS n FROM curated GROUP BY extension_id))
    SELECT q.*, z.*, array_to_string(list_filter([CASE WHEN test_records < 5 THEN 'test split contains fewer than five records' END, CASE WHEN test_extensions < 2 THEN 'test split contains fewer than two extension identities' END,
    'protected split leakage detected'], lambda x: x IS NOT NULL), '; ') AS block_reasons FROM q, z"""
)
def split_quality(spark, sf_dir):
    """Counts per split, pairs per extension, block reasons."""
    report = audits.split_quality(curated_records(spark, sf_dir)).drop("leakage_violations", "warnings")
    counts = [name for name in report.columns if name.endswith("_eligible_labels")]
    return report.withColumns({name: C(name).cast("long") for name in counts}).withColumn("block_reasons", F.array_join("block_reasons", "; "))


@query(f"WITH {CUR} SELECT split, label, count(*) AS records, count(*) FILTER (WHERE eligible) AS eligible FROM curated WHERE split IN ('train', 'validation', 'test') GROUP BY 1, 2")
def split_label_counts(spark, sf_dir):
    return audits.split_label_counts(curated_records(spark, sf_dir))


@query(f"WITH {t.RECORDS_SQL} SELECT record_id, 'label' AS feature, 'benign' AS term FROM records WHERE contains(label, 'benign') UNION ALL SELECT record_id, 'label', 'risky' FROM records WHERE contains(label, 'risky')")
def feature_value_leaks(spark, sf_dir):
    """Label-like text in columns that claim to be features."""
    return audits.feature_value_leaks(t.records(spark, sf_dir), ["label", "lang", "license"])


@query(f"WITH {t.RECORDS_SQL} SELECT extension_id, string_agg(DISTINCT split, '|' ORDER BY split) AS splits FROM records GROUP BY 1 HAVING count(DISTINCT split) > 1")
def feature_group_leaks(spark, sf_dir):
    return audits.feature_group_leaks(t.records(spark, sf_dir)).withColumn("splits", F.array_join("splits", "|"))


@query(f"""WITH {d.LABELLED_SQL} SELECT count(*) AS record_count, count(DISTINCT extension_id) AS unique_extension_count, count(DISTINCT label) AS class_count, count(*) FILTER (WHERE split = 'train') AS train_records,
    count(*) FILTER (WHERE split = 'test') AS test_records, count(*) AS real_record_count, true AS ml_training_permitted, '' AS ml_block_reasons FROM labelled""")
def dataset_readiness(spark, sf_dir):
    """Readiness of the order feature table for training."""
    report = audits.readiness(d.pair_features(spark, sf_dir))
    return report.select(
        "record_count", "unique_extension_count", C("class_count").cast("long").alias("class_count"), "train_records", "test_records", "real_record_count",
        "ml_training_permitted", F.array_join("ml_block_reasons", "; ").alias("ml_block_reasons"),
    )


_GATE_NAMES = ["pilot", "supervised", "replication", "maturation_60", "maturation_75"]
_GATE_FACTS = {
    "provenance_complete_count": "record_count", "duplicates_passed": "false", "leakage_passed": "false", "validation_passed": "false",
    "failed_records": "0", "missing_analyzer_count": "0",
}


@query(
    f"""WITH {CUR}, f AS (SELECT count(*) AS record_count, count(*) FILTER (WHERE NOT is_controlled) AS real_record_count, count(*) FILTER (WHERE eligible) AS eligible_count, count(DISTINCT extension_id) AS unique_extension_count,
      count(DISTINCT CASE WHEN eligible THEN extension_id END) AS eligible_extensions, count(*) FILTER (WHERE split = 'test') AS test_records, count(DISTINCT CASE WHEN split = 'test' THEN extension_id END) AS test_extensions,
      count(DISTINCT CASE WHEN eligible AND split = 'test' THEN label END) AS test_eligible_labels, count(DISTINCT CASE WHEN eligible THEN label END) AS eligible_label_count,
      {", ".join(f"count(DISTINCT CASE WHEN eligible AND split = '{s}' THEN label = 'risky_transition' END) AS {s}_classes" for s in vocab.SPLITS)},
      count(*) FILTER (WHERE label = 'uncertain') AS uncertain_count, count(*) FILTER (WHERE label = 'uncertain' AND eligible) AS eligible_uncertain_count,
      count(*) FILTER (WHERE label_quality_tier = 'SINGLE_REVIEWER_PROVISIONAL') AS provisional_count, count(*) FILTER (WHERE label_quality_tier = 'UNCERTAIN') AS uncertain_tier_count FROM curated),
    g AS (SELECT *, {", ".join(f"{value} AS {name}" for name, value in _GATE_FACTS.items())} FROM f) """
    + " UNION ALL ".join(
        f"""SELECT '{name}' AS gate, array_to_string(list_filter([{', '.join(f"CASE WHEN {c} THEN '{m}' END" for c, m, k in audits.GATES[name] if k == 'block')}], lambda x: x IS NOT NULL), '; ') AS block_reasons,
        array_to_string(list_filter([{', '.join(f"CASE WHEN {c} THEN '{m}' END" for c, m, k in audits.GATES[name] if k == 'warn') or 'NULL'}], lambda x: x IS NOT NULL), '; ') AS warnings FROM g"""
        for name in _GATE_NAMES
    )
)
def readiness_gates(spark, sf_dir):
    """All corpus gates on the facts of the curated records."""
    counted = audits.corpus_facts(curated_records(spark, sf_dir)).withColumns({name: F.expr(value) for name, value in _GATE_FACTS.items()})
    parts = [
        audits.gate(counted, audits.GATES[name]).select(
            F.lit(name).alias("gate"), F.array_join("block_reasons", "; ").alias("block_reasons"), F.array_join("warnings", "; ").alias("warnings")
        )
        for name in _GATE_NAMES
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


_SUPERVISED_RULES = audits.GATES["supervised"] + audits.GATES["groups"]


@query(
    f"""WITH {CUR}, e AS (SELECT * FROM curated WHERE eligible AND label IN ({", ".join(f"'{n}'" for n in vocab.TARGET_MAPPING)})),
    h AS (SELECT old_sha256 AS sha, split FROM e UNION ALL SELECT new_sha256, split FROM e),
    g AS (SELECT (SELECT count(*) FROM e) AS eligible_count, (SELECT count(DISTINCT extension_id) FROM e) AS eligible_extensions,
      {", ".join(f"(SELECT count(DISTINCT label = 'benign_transition') FROM e WHERE split = '{s}') AS {s}_classes" for s in vocab.SPLITS)},
      (SELECT count(*) FROM (SELECT 1 FROM e GROUP BY extension_id HAVING count(DISTINCT split) > 1)) AS extension_overlap,
      (SELECT count(*) FROM (SELECT 1 FROM h WHERE sha <> '' GROUP BY sha HAVING count(DISTINCT split) > 1)) AS package_hash_overlap,
      (SELECT count(*) FROM (SELECT 1 FROM e WHERE old_sha256 <> '' AND new_sha256 <> '' GROUP BY old_sha256, new_sha256 HAVING count(*) > 1)) AS duplicate_transition_pairs)
    SELECT *, array_to_string(list_filter([{", ".join(f"CASE WHEN {c} THEN '{m}' END" for c, m, _ in _SUPERVISED_RULES)}], lambda x: x IS NOT NULL), '; ') AS block_reasons, NOT ({" OR ".join(f"({c})" for c, _, _ in _SUPERVISED_RULES)}) AS ready FROM g"""
)
def experiment_gate(spark, sf_dir):
    """Whether the curated records may be trained on: sizes, classes and overlap of extensions, packages and transitions."""
    eligible = features.supervised(curated_records(spark, sf_dir))
    found = audits.supervised_gate(eligible, t.records(spark, sf_dir))
    return found.withColumns({f"{name}_classes": C(f"{name}_classes").cast("long") for name in vocab.SPLITS}).withColumn("block_reasons", F.array_join("block_reasons", "; "))


@query(f"WITH {CUR} SELECT " + ", ".join(f"count(*) FILTER (WHERE label_quality_tier = '{n}') AS {n.lower()}" for n in vocab.QUALITY_TIERS) + ", count(*) FILTER (WHERE label_quality_tier = 'MULTI_REVIEWER_ADJUDICATED') AS double_reviewed_count, count(*) FILTER (WHERE eligible) AS eligible_supervised_training_count, count(*) FILTER (WHERE eligible AND label = 'uncertain') AS uncertain_training_eligible_count FROM curated")
def label_quality(spark, sf_dir):
    return audits.label_quality(curated_records(spark, sf_dir))


@query(f"WITH {CUR} SELECT coalesce(nullif(functional_category, ''), 'unknown') AS category, count(DISTINCT extension_id) AS extensions, count(*) AS transitions, " + ", ".join(f"count(*) FILTER (WHERE label = '{n}') AS {n}" for n in vocab.LABELS) + " FROM curated GROUP BY 1")
def category_diversity(spark, sf_dir):
    return audits.diversity(curated_records(spark, sf_dir))


@query(f"""WITH {CUR}, f AS (SELECT count(*) AS n, count(*) FILTER (WHERE old_timestamp IS NOT NULL AND new_timestamp IS NOT NULL) AS dated, count(*) FILTER (WHERE label_quality_tier = 'SINGLE_REVIEWER_PROVISIONAL') AS p, count(DISTINCT extension_id) AS e FROM curated)
    SELECT n AS record_count, n AS provenance_complete_count, dated AS timestamp_complete_count, n || '/' || n AS provenance_completeness, dated || '/' || n AS timestamp_completeness, round(p * 100.0 / n, 6)::DOUBLE AS single_reviewer_provisional_percentage, e AS extension_diversity FROM f""")
def dataset_quality(spark, sf_dir):
    return audits.dataset_quality(curated_records(spark, sf_dir))


@query(f"WITH {d.LABELLED_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS analyzer_flag, CAST(0 AS BIGINT) AS missing" for n in [*(f"{a}_available" for a in vocab.ANALYZERS), "total"]))
def analyzer_missingness(spark, sf_dir):
    return audits.analyzer_missingness(d.pair_features(spark, sf_dir))


@query(f"""WITH {CUR}, a AS (SELECT * FROM curated WHERE new_doc % 2 = 1), f AS (SELECT (SELECT count(*) FROM a) AS o, count(*) AS n, (SELECT count(*) FILTER (WHERE eligible) FROM a) AS oe, count(*) FILTER (WHERE eligible) AS ne, (SELECT count(DISTINCT extension_id) FROM a) AS ox, count(DISTINCT extension_id) AS nx FROM curated)
    SELECT 'record_count' AS metric, CAST(o AS VARCHAR) AS old_value, CAST(n AS VARCHAR) AS new_value FROM f UNION ALL SELECT 'eligible_count', CAST(oe AS VARCHAR), CAST(ne AS VARCHAR) FROM f UNION ALL SELECT 'unique_extension_count', CAST(ox AS VARCHAR), CAST(nx AS VARCHAR) FROM f""")
def dataset_comparison(spark, sf_dir):
    """Two dataset versions side by side."""
    rows = curated_records(spark, sf_dir)
    shown = ["record_count", "eligible_count", "unique_extension_count"]
    return audits.compare_metrics(audits.corpus_facts(rows.where(C("new_doc") % 2 == 1)).select(*shown), audits.corpus_facts(rows).select(*shown))


@query(f"""WITH {CUR} SELECT label, count(*) AS all_eligible, count(*) FILTER (WHERE label_quality_tier NOT IN ('SINGLE_REVIEWER_PROVISIONAL', 'UNCERTAIN')) AS higher_confidence, count(*) FILTER (WHERE NOT is_controlled) AS real_only, count(*) FILTER (WHERE is_controlled) AS controlled_only FROM curated WHERE eligible GROUP BY 1""")
def label_subsets(spark, sf_dir):
    return audits.label_subsets(curated_records(spark, sf_dir).where("eligible_for_supervised_training"))


@query(f"WITH {CUR} SELECT record_id, stage, array_to_string(list_concat(reasons, warnings), '; ') AS reasons FROM curated WHERE len(reasons) > 0 OR len(warnings) > 0")
def validation_report(spark, sf_dir):
    """One of the seven curation reports: records with reasons."""
    report = reports.curation_reports(curated_records(spark, sf_dir))["validation"]
    return report.withColumn("reasons", F.array_join("reasons", "; "))


@query(f"WITH {CUR} SELECT record_id, source_type || ':' || record_id AS provenance_id, extension_id, source_type, source_reference, old_sha256, new_sha256, label_source, label_review_status, label_quality_tier, eligible AS eligible_for_supervised_training, false AS complete FROM curated WHERE stage = 'ACCEPTED'")
def provenance_report(spark, sf_dir):
    return reports.curation_reports(curated_records(spark, sf_dir))["provenance"]


@query(f"WITH {CUR} SELECT record_id, license, license_status, stage FROM curated")
def license_report(spark, sf_dir):
    return reports.curation_reports(curated_records(spark, sf_dir))["license"].select("record_id", "license", "license_status", "stage")


@query(f"WITH {t.RECORDS_SQL} SELECT record_id, old_version, new_version, extension_id FROM records")
def import_records(spark, sf_dir):
    """Nested import records flattened to columns."""
    side = lambda name: F.struct(
        *[C(f"{name}_{field}").alias(field) if f"{name}_{field}" in ("old_version", "new_version", "old_timestamp", "new_timestamp") else F.lit(None).cast("string").alias(field)
          for field in ("path", "version", "timestamp", "extension_id", "sha256", "raw_sha256")]
    ).alias(name)
    nested = t.records(spark, sf_dir).select("record_id", C("extension_id"), side("old"), side("new"))
    return curation.flatten_import(nested).select("record_id", "old_version", "new_version", "extension_id")


# -- manifests --------------------------------------------------------------
def order_manifests(spark, sf_dir):
    """A manifest per order: brands as permissions, every third supplier host among them, the others apart."""
    lines = t.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    parts = t.load(spark, sf_dir, "part").select("p_partkey", "p_brand")
    host = t._host_of_supplier(C("l_suppkey"))
    listed = lines.join(parts, C("l_partkey") == C("p_partkey")).groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct(C("p_brand").alias("brand"), "l_suppkey", host.alias("host")))).alias("items")
    )
    orders = t.load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    joined = orders.join(listed, C("o_orderkey") == C("l_orderkey"))
    brands = F.transform("items", lambda item: item["brand"])
    inline_hosts = F.transform(F.filter("items", lambda item: item["l_suppkey"] % 3 == 0), lambda item: item["host"])
    other_hosts = F.transform(F.filter("items", lambda item: item["l_suppkey"] % 3 != 0), lambda item: item["host"])
    body = F.struct(
        F.when(C("o_orderkey") % 4 != 0, C("o_orderkey") % 2 + 2).alias("manifest_version"),
        F.concat(F.lit("Order "), C("o_orderstatus")).alias("name"),
        F.concat(brands, inline_hosts).alias("permissions"),
        other_hosts.alias("host_permissions"),
        F.when(C("o_orderpriority") == "1-URGENT", F.struct(C("o_orderstatus").alias("service_worker"))).alias("background"),
        F.when(C("o_orderpriority") == "5-LOW", F.lit("self")).alias("content_security_policy"),
    )
    return joined.select(C("o_orderkey").cast("string").alias("package_id"), F.to_json(body).alias("manifest"))


_MANIFEST_SQL = t.ORDER_LINES_SQL + """,
ml AS (SELECT l_orderkey, p_brand, l_suppkey, CASE WHEN l_suppkey % 40 = 0 THEN '<all_urls>' WHEN l_suppkey % 10 = 1 THEN 'https://*.s' || l_suppkey || '.example/*'
  WHEN l_suppkey % 10 = 2 THEN 'http://www.*.s' || l_suppkey || '.example/*' ELSE 'https://s' || l_suppkey || '.example/*' END AS host FROM lineitem JOIN part ON l_partkey = p_partkey),
man AS (SELECT o_orderkey, any_value(o_orderpriority) AS pr, any_value(o_orderstatus) AS st, CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE o_orderkey % 2 + 2 END AS mv, count(*) AS permission_count,
  count(*) FILTER (WHERE l_suppkey % 3 = 0) AS inline_hosts, len(list_filter(coalesce(list(DISTINCT host) FILTER (WHERE l_suppkey % 3 <> 0), []), lambda h: NOT list_contains(coalesce(list(host) FILTER (WHERE l_suppkey % 3 = 0), []), h))) AS other_hosts, min(p_brand) AS first_permission
  FROM orders JOIN ml ON o_orderkey = l_orderkey GROUP BY o_orderkey)"""


@query(f"WITH {_MANIFEST_SQL} SELECT CAST(o_orderkey AS VARCHAR) AS package_id, CAST(mv AS BIGINT) AS manifest_version, 'Order ' || st AS name, permission_count, inline_hosts + CASE WHEN mv >= 3 THEN other_hosts ELSE 0 END AS host_count, first_permission, (pr = '1-URGENT') AS has_background FROM man")
def manifest_projection(spark, sf_dir):
    """Fixed columns out of one JSON manifest per order."""
    projected = manifests.project_manifests(order_manifests(spark, sf_dir))
    return projected.select(
        "package_id", C("manifest_version").cast("long").alias("manifest_version"), "name", F.size("permissions").cast("long").alias("permission_count"),
        F.size("hosts").cast("long").alias("host_count"), F.get("permissions", F.lit(0)).alias("first_permission"), (C("background") != "{}").alias("has_background"),
    )


@query(
    f"""WITH {_MANIFEST_SQL} SELECT p.pair_id, (a.pr <> '1-URGENT' AND b.pr = '1-URGENT') AS background_added,
      (CASE WHEN a.pr = '1-URGENT' THEN a.st ELSE '' END <> CASE WHEN b.pr = '1-URGENT' THEN b.st ELSE '' END) AS background_changed, ((a.pr = '5-LOW') <> (b.pr = '5-LOW')) AS csp_changed,
      false AS content_scripts_changed FROM pairs p JOIN man a ON ok = a.o_orderkey JOIN man b ON nk = b.o_orderkey"""
)
def manifest_changes(spark, sf_dir):
    """Manifest changes of consecutive orders that both have lines."""
    projected = manifests.project_manifests(order_manifests(spark, sf_dir))
    items = drift.items(t.order_pairs(spark, sf_dir), facts.permission_facts(projected))
    both = drift.summary(t.order_pairs(spark, sf_dir), items).where(C("old_version").isNotNull() & C("new_version").isNotNull())
    return both.select("pair_id", "background_added", "background_changed", "csp_changed", "content_scripts_changed")


# -- reviews ----------------------------------------------------------------
REV = t.REVIEWS_SQL


def _side(spark, sf_dir, role):
    return t.reviews(spark, sf_dir).where(C("reviewer_id") == role)


def compared(spark, sf_dir):
    return reviews.compare_reviewers(_side(spark, sf_dir, "user"), _side(spark, sf_dir, "assistant"))


def project_records(spark, sf_dir):
    """A project label and tier per conversation."""
    conversations = t.load(spark, sf_dir, "conversations").select(C("conv_id").alias("record_id")).distinct()
    labels = list(vocab.LABELS)
    tiers = vocab.QUALITY_TIERS
    pick = lambda values, key: F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))
    key = C("record_id")
    return conversations.select(
        "record_id", F.concat(F.lit("e"), (key % 9).cast("string")).alias("extension_id"), pick(labels, key).alias("label"), pick(tiers, key).alias("label_quality_tier"),
        F.lit("single_reviewer_provisional").alias("label_source"), (key % 3 != 0).alias("eligible_for_supervised_training"), (key % 5 == 0).alias("is_controlled"),
        F.sha2(F.concat(F.lit("o"), key.cast("string")), 256).alias("old_sha256"), F.when(key % 7 != 0, F.sha2(F.concat(F.lit("n"), key.cast("string")), 256)).alias("new_sha256"),
        F.concat(F.lit("p:"), key.cast("string")).alias("provenance_id"), F.when(key % 4 == 0, F.array(F.lit("new record"))).otherwise(F.array().cast("array<string>")).alias("notes"),
    )


def holdout_records(spark, sf_dir):
    return project_records(spark, sf_dir).where(C("record_id") % 6 == 0).select("record_id")


PROJECT_SQL = REV + f""",
project AS (SELECT record_id, 'e' || (record_id % 9) AS extension_id, {t._pick_sql('record_id', list(vocab.LABELS))} AS label, {t._pick_sql('record_id', vocab.QUALITY_TIERS)} AS label_quality_tier,
  record_id % 3 <> 0 AS eligible, record_id % 5 = 0 AS is_controlled, record_id % 7 <> 0 AS hashed, record_id % 6 = 0 AS held, record_id % 4 = 0 AS fresh FROM (SELECT DISTINCT conv_id AS record_id FROM conversations))"""


_AI = "AI assistance cannot be represented as an independent reviewer"


@query(f"""WITH {REV} SELECT record_id, reviewer_id, array_to_string(list_filter([CASE WHEN independent_label = 'NO_OPINION' THEN 'invalid independent_label' END, CASE WHEN reviewer_id = 'assistant' THEN '{_AI}' END,
    CASE WHEN rationale IS NULL THEN 'rationale is required' END], lambda x: x IS NOT NULL), '; ') AS errors FROM reviews""")
def review_validation(spark, sf_dir):
    return reviews.basic_errors(t.reviews(spark, sf_dir)).select("record_id", "reviewer_id", F.array_join("errors", "; ").alias("errors"))


def conversation_packets(conversations):
    """{record_id, packet} of each conversation: the first turn there is as the difference, and all turns by their place."""
    turn = F.struct(C("turn").isNull().alias("last"), "turn", C("text").alias("body"), "role")
    rows = conversations.groupBy(C("conv_id").alias("record_id")).agg(F.sort_array(F.collect_list(turn)).alias("all"))
    turns = F.map_from_entries(F.transform("all", lambda x, at: F.struct(at.cast("string"), x.dropFields("last"))))
    first = C("all")[0]
    return rows.select("record_id", F.to_json(F.struct(first.dropFields("last", "turn").alias("diff"), first["turn"].alias("turn"), turns.alias("turns"))).alias("packet"))


@query(f"""WITH {REV} SELECT record_id, array_to_string(list_filter([CASE WHEN independent_label = 'NO_OPINION' THEN 'independent_label is invalid' END, CASE WHEN rationale IS NULL THEN 'rationale is required' END,
    CASE WHEN record_id % 2 = 0 THEN 'every evidence reference must resolve to a packet field' END], lambda x: x IS NOT NULL), '; ') AS errors FROM reviews WHERE reviewer_id = 'user'""")
def strict_review_validation(spark, sf_dir):
    """Full form check; references must name a field of the packet built from all turns of the conversation."""
    packets = conversation_packets(t.load(spark, sf_dir, "conversations"))
    rows = _side(spark, sf_dir, "user").withColumns(
        {
            "evidence_references": F.when(C("record_id") % 2 == 0, F.array(F.lit("diff.gone"))).otherwise(F.array(F.lit("diff.body"), F.lit("turn"))),
            "blind_review": F.lit(True), "review_status": F.lit("SUBMITTED"), "review_timestamp": F.lit("2024-05-01T10:00:00Z"),
            "review_id": F.concat(F.lit("HRV1::user::"), C("record_id").cast("string"), F.lit("::INITIAL_BLIND")), "record_id": C("record_id").cast("string"),
        }
    )
    fields = reviews.packet_fields(packets.withColumn("record_id", C("record_id").cast("string")))
    checked = reviews.strict_errors(rows, fields, "user")
    return checked.select(C("record_id").cast("long").alias("record_id"), F.array_join("errors", "; ").alias("errors"))


@query(f"""WITH {REV}, a AS (SELECT record_id FROM reviews WHERE reviewer_id = 'user'), b AS (SELECT record_id FROM reviews WHERE reviewer_id = 'assistant')
    SELECT coalesce(a.record_id, b.record_id) AS record_id, CASE WHEN b.record_id IS NULL THEN 'missing_from_second' WHEN a.record_id IS NULL THEN 'extra_in_second' ELSE 'common' END AS place FROM a FULL JOIN b ON a.record_id = b.record_id""")
def reviewer_case_sets(spark, sf_dir):
    return reviews.case_sets(_side(spark, sf_dir, "user"), _side(spark, sf_dir, "assistant"))


@query(f"WITH {REV} SELECT record_id, first_label, second_label, first_mapped, second_mapped, comparable, CASE WHEN comparable THEN first_mapped = second_mapped END AS exact_match, confidence_pair FROM compared")
def reviewer_comparison(spark, sf_dir):
    return compared(spark, sf_dir).drop("first_confidence", "second_confidence")


_KAPPA_SQL = """ct AS (SELECT first_mapped AS l, second_mapped AS r, count(*) AS n FROM compared WHERE comparable GROUP BY 1, 2),
tot AS (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(coalesce(sum(n) FILTER (WHERE l = r), 0) AS BIGINT) AS e FROM ct),
ch AS (SELECT sum(a.n::DOUBLE * b.n) AS c FROM (SELECT l, sum(n) AS n FROM ct GROUP BY 1) a JOIN (SELECT r, sum(n) AS n FROM ct GROUP BY 1) b ON l = r),
kap AS (SELECT n AS comparable_count, e AS exact_count, e::DOUBLE / n AS po, c / (n::DOUBLE * n) AS pe FROM tot, ch)"""


@query(f"WITH {REV}, {_KAPPA_SQL} SELECT comparable_count, exact_count, round(po, 12) AS observed_agreement, round(pe, 12) AS expected_agreement, round((po - pe) / (1 - pe), 12) AS cohens_kappa, 'AVAILABLE_UNWEIGHTED' AS status FROM kap")
def cohens_kappa(spark, sf_dir):
    pairs = compared(spark, sf_dir).select(C("first_mapped").alias("left"), C("second_mapped").alias("right"))
    rounded = lambda name: F.round(name, 12).alias(name)
    return metrics.cohens_kappa(pairs).select(
        "comparable_count", "exact_count", rounded("observed_agreement"), rounded("expected_agreement"), rounded("cohens_kappa"), "status"
    )


@query(f"""WITH {REV}, {_KAPPA_SQL} SELECT (SELECT count(*) FROM compared) AS total_common_cases, comparable_count AS comparable_cases, exact_count AS exact_agreements, comparable_count - exact_count AS disagreements,
    round(100.0 * exact_count / comparable_count, 9)::DOUBLE AS percent_exact_agreement, round((po - pe) / (1 - pe), 9) AS cohens_kappa FROM kap""")
def agreement_summary(spark, sf_dir):
    summary = reviews.agreement_summary(compared(spark, sf_dir)).drop("kappa_status")
    return summary.withColumns({name: F.round(name, 9) for name in ("percent_exact_agreement", "cohens_kappa")})


@query("WITH " + REV + " SELECT l.label AS first_mapped, " + ", ".join(f"count(c.record_id) FILTER (WHERE c.second_mapped = '{n}') AS {n}" for n in vocab.HUMAN_LABELS.values()) + " FROM (VALUES " + ", ".join(f"('{n}')" for n in vocab.HUMAN_LABELS.values()) + ") l(label) LEFT JOIN compared c ON c.first_mapped = l.label AND c.comparable GROUP BY 1")
def label_matrix(spark, sf_dir):
    return reviews.label_matrix(compared(spark, sf_dir))


@query(f"WITH {REV} SELECT confidence_pair, count(*) AS case_count, count(*) FILTER (WHERE first_mapped = second_mapped) AS exact_agreement_count, count(*) FILTER (WHERE first_mapped = second_mapped)::DOUBLE / count(*) AS exact_agreement_rate FROM compared WHERE comparable GROUP BY 1")
def confidence_agreement(spark, sf_dir):
    return reviews.confidence_agreement(compared(spark, sf_dir))


@query(f"WITH {PROJECT_SQL}, j AS (SELECT label, mapped FROM mapped JOIN project USING (record_id) WHERE reviewer_id = 'user') SELECT count(*) AS record_count, count(*) FILTER (WHERE mapped <> 'NOT_COMPARABLE') AS comparable_record_count, count(*) FILTER (WHERE mapped = label) AS exact_match_count, count(*) FILTER (WHERE mapped = label)::DOUBLE / count(*) FILTER (WHERE mapped <> 'NOT_COMPARABLE') AS exact_match_proportion FROM j")
def label_concordance(spark, sf_dir):
    return reviews.concordance_summary(reviews.concordance(_side(spark, sf_dir, "user"), project_records(spark, sf_dir)))


@query(f"WITH {PROJECT_SQL} SELECT label AS project_label, mapped AS human_label, count(*) AS records FROM mapped JOIN project USING (record_id) WHERE reviewer_id = 'user' AND mapped <> 'NOT_COMPARABLE' GROUP BY 1, 2")
def concordance_table(spark, sf_dir):
    """Project labels against human labels."""
    return reviews.concordance_table(reviews.concordance(_side(spark, sf_dir, "user"), project_records(spark, sf_dir)))


_STATUS_SQL = "st AS (SELECT record_id, count(*) AS reviews, count(DISTINCT reviewer_id) AS reviewers, count(DISTINCT independent_label) AS labels, CASE WHEN count(DISTINCT reviewer_id) < 2 THEN 'single_review_only' WHEN count(DISTINCT independent_label) = 1 THEN 'agreement' ELSE 'disagreement_pending_adjudication' END AS disagreement_status FROM reviews GROUP BY 1)"


@query(f"WITH {REV}, {_STATUS_SQL} SELECT * FROM st")
def adjudication_status(spark, sf_dir):
    return reviews.adjudication_status(t.reviews(spark, sf_dir)).withColumn("labels", C("labels").cast("long"))


@query(f"WITH {REV}, {_STATUS_SQL}, c AS (SELECT count(*) FILTER (WHERE disagreement_status = 'agreement') AS a, count(*) FILTER (WHERE disagreement_status LIKE 'disa%') AS b FROM st) SELECT a AS agreement_count, b AS disagreement_count, a + b AS double_reviewed_record_count, CASE WHEN a + b >= 2 THEN a::DOUBLE / (a + b) END AS agreement_percentage, 'INTER_RATER_AGREEMENT_AVAILABLE_EXACT_ONLY' AS status FROM c")
def inter_rater_availability(spark, sf_dir):
    return reviews.inter_rater(reviews.adjudication_status(t.reviews(spark, sf_dir)))


@query(f"WITH {REV}, j AS (SELECT a.record_id, a.independent_label AS x, b.independent_label AS y, CAST('0x' || sha256('reviewer-alias-v1::' || a.record_id)[1:2] AS INT) % 2 = 1 AS swapped FROM reviews a JOIN reviews b ON a.record_id = b.record_id AND a.reviewer_id = 'user' AND b.reviewer_id = 'assistant') SELECT record_id, CASE WHEN swapped THEN y ELSE x END AS label_a, CASE WHEN swapped THEN x ELSE y END AS label_b FROM j")
def deidentified_opinions(spark, sf_dir):
    opinions = reviews.deidentified_opinions(_side(spark, sf_dir, "user"), _side(spark, sf_dir, "assistant"))
    return opinions.select("record_id", C("reviewer_a.label").alias("label_a"), C("reviewer_b.label").alias("label_b"))


@query(f"""WITH {PROJECT_SQL}, s AS (SELECT record_id, independent_label, rationale FROM reviews WHERE reviewer_id = 'assistant'), e AS (SELECT record_id FROM project)
    SELECT record_id, 'packet hash changed' AS error FROM e WHERE record_id % 10 = 0 UNION ALL SELECT record_id, 'submission is missing' FROM e ANTI JOIN s USING (record_id)
    UNION ALL SELECT record_id, 'invalid independent_label' FROM s WHERE independent_label = 'NO_OPINION' UNION ALL SELECT record_id, 'rationale is required' FROM s WHERE rationale IS NULL UNION ALL SELECT record_id, '{_AI}' FROM s""")
def stage_release_gate(spark, sf_dir):
    """What keeps the second stage locked."""
    rows = project_records(spark, sf_dir)
    expected = rows.select("record_id", C("old_sha256").alias("packet_sha256"))
    packets = rows.select("record_id", F.when(C("record_id") % 10 == 0, "changed").otherwise(C("old_sha256")).alias("packet_sha256"))
    submissions = reviews.basic_errors(_side(spark, sf_dir, "assistant")).select("record_id", "errors")
    return reviews.release_gate(expected, packets, submissions)


@query(f"WITH {REV} SELECT record_id, first_label, second_label AS final_label, first_label <> second_label AS changed FROM compared")
def stage_comparison(spark, sf_dir):
    stage = lambda role: _side(spark, sf_dir, role).select("record_id", C("independent_label").alias("label"))
    return reviews.stage_comparison(stage("user"), stage("assistant"))


_ASSESSED_SQL = """fin AS (SELECT record_id, second_label AS final_label, second_mapped AS semantic_label FROM compared WHERE second_mapped <> 'NOT_COMPARABLE'),
assessed AS (SELECT fin.*, label_quality_tier AS current_tier, hashed, held, CASE WHEN semantic_label IN ('uncertain', 'excluded') THEN 'UNCERTAIN' ELSE 'MULTI_REVIEWER_ADJUDICATED' END AS assessed_tier FROM fin JOIN project USING (record_id))"""


def _assessed(spark, sf_dir):
    final = _side(spark, sf_dir, "assistant").where(C("independent_label") != "NO_OPINION")
    both = final.join(_side(spark, sf_dir, "user").select("record_id"), "record_id").select("record_id", C("independent_label").alias("final_label"))
    return reviews.promotion_assessment(both, project_records(spark, sf_dir))


@query(f"WITH {PROJECT_SQL}, {_ASSESSED_SQL} SELECT record_id, final_label, semantic_label, current_tier, assessed_tier, assessed_tier <> 'UNCERTAIN' AS eligible, CASE WHEN assessed_tier <> 'UNCERTAIN' THEN 'ELIGIBLE_FOR_PROMOTION' ELSE 'NOT_ELIGIBLE_SEMANTIC_LABEL_UNCERTAIN' END AS assessment FROM assessed")
def promotion_assessment(spark, sf_dir):
    return _assessed(spark, sf_dir)


@query(f"WITH {PROJECT_SQL} SELECT record_id, first_label AS agreed_label, label_quality_tier AS current_tier, label_quality_tier IN ('CONTROLLED_GROUND_TRUTH', 'EXTERNAL_CONFIRMED', 'MULTI_REVIEWER_ADJUDICATED') AS qualifies FROM compared JOIN project USING (record_id) WHERE comparable AND first_mapped = second_mapped")
def agreed_assessment(spark, sf_dir):
    return reviews.agreed_assessment(compared(spark, sf_dir), project_records(spark, sf_dir)).drop("assessment")


@query(f"""WITH {PROJECT_SQL}, {_ASSESSED_SQL}, dec AS (SELECT *, assessed_tier <> 'UNCERTAIN' AND record_id % 8 <> 0 AS ok FROM assessed)
    SELECT record_id, CASE WHEN ok THEN 'APPROVED' ELSE 'NOT_QUALIFYING' END AS promotion_decision, CASE WHEN ok THEN 'MULTI_REVIEWER_ADJUDICATED' ELSE 'UNCERTAIN' END AS target_quality_tier,
    array_to_string(list_filter([CASE WHEN NOT ok THEN 'NOT_APPROVED_FOR_DEFINITIVE_QUALITY_PROMOTION' END, CASE WHEN semantic_label = 'uncertain' THEN 'UNCERTAIN_SEMANTIC_LABEL_EXCLUDED' END, CASE WHEN NOT hashed THEN 'PROVENANCE_INCOMPLETE' END, CASE WHEN held THEN 'EXTERNAL_HOLDOUT_FORBIDDEN' END], lambda x: x IS NOT NULL), '; ') AS reasons,
    'QPD1::' || sha256('{{"promotion_decision":"' || CASE WHEN ok THEN 'APPROVED' ELSE 'NOT_QUALIFYING' END || '","record_id":' || record_id || ',"semantic_label":"' || semantic_label || '","target_quality_tier":"' || CASE WHEN ok THEN 'MULTI_REVIEWER_ADJUDICATED' ELSE 'UNCERTAIN' END || '"}}') AS decision_id FROM dec""")
def promotion_decisions(spark, sf_dir):
    """Decision, target tier, reasons and content-derived id of every assessed record."""
    rows = project_records(spark, sf_dir)
    decided = reviews.promotion_decisions(_assessed(spark, sf_dir), rows, holdout_records(spark, sf_dir), rows.where(C("record_id") % 8 != 0))
    return decided.select("record_id", "promotion_decision", "target_quality_tier", F.array_join("non_ready_reasons", "; ").alias("reasons"), "decision_id")


@query(f"""WITH {PROJECT_SQL} SELECT record_id, 'frozen row hash differs' AS failure FROM project WHERE record_id % 11 = 0 UNION ALL SELECT record_id, 'promotion frozen-row hash differs' FROM project WHERE record_id % 11 = 0
    UNION ALL SELECT record_id, 'derived tier differs' FROM project WHERE record_id % 13 = 0 AND label_quality_tier <> 'UNCERTAIN'""")
def promotion_lineage(spark, sf_dir):
    """Records whose decision, derived view and frozen row disagree."""
    from deltascope.functions import ids

    frozen = project_records(spark, sf_dir).select("record_id", "extension_id", "label", "label_quality_tier")
    digest = ids.canonical_hash(F.struct(*sorted(frozen.columns)))
    decisions = frozen.select("record_id", C("label_quality_tier").alias("target_quality_tier"), digest.alias("frozen_sha256"))
    view = frozen.select(
        "record_id", F.when(C("record_id") % 13 == 0, "UNCERTAIN").otherwise(C("label_quality_tier")).alias("derived_quality_tier"),
        F.when(C("record_id") % 11 == 0, "other").otherwise(digest).alias("frozen_sha256"),
    )
    return reviews.lineage_failures(decisions, view, frozen)


@query(f"""WITH {PROJECT_SQL}, {_STATUS_SQL} SELECT record_id, array_to_string(list_filter([CASE WHEN label IN ('uncertain', 'excluded') THEN label || ' is not supervised-training eligible' END, CASE WHEN disagreement_status LIKE 'disa%' THEN 'unresolved reviewer disagreement' END,
    CASE WHEN label_quality_tier = 'UNCERTAIN' THEN 'uncertain label-quality tier' END, CASE WHEN held THEN 'external holdout excluded from supervised training' END], lambda x: x IS NOT NULL), '; ') AS eligibility_reasons,
    (eligible AND label NOT IN ('uncertain', 'excluded') AND NOT disagreement_status LIKE 'disa%' AND label_quality_tier <> 'UNCERTAIN' AND NOT held) AS eligible FROM project LEFT JOIN st USING (record_id)""")
def reviewed_eligibility(spark, sf_dir):
    statuses = reviews.adjudication_status(t.reviews(spark, sf_dir))
    checked = reviews.reviewed_eligibility(project_records(spark, sf_dir), statuses, holdout_records(spark, sf_dir))
    return checked.select("record_id", "eligible", F.array_join("eligibility_reasons", "; ").alias("eligibility_reasons"))


_GOLD_SQL = "gold AS (SELECT *, CASE WHEN is_controlled THEN 'controlled' ELSE 'real' END AS kind FROM project WHERE label_quality_tier IN ('CONTROLLED_GROUND_TRUTH', 'EXTERNAL_CONFIRMED', 'MULTI_REVIEWER_ADJUDICATED') AND label NOT IN ('uncertain', 'excluded') AND hashed AND NOT held)"


@query(f"WITH {PROJECT_SQL}, {_GOLD_SQL} SELECT record_id, extension_id, label, label_quality_tier AS label_source, 'TIER_5' AS evidence_tier, kind AS real_or_controlled FROM gold")
def gold_set(spark, sf_dir):
    return reviews.gold_set(project_records(spark, sf_dir), holdout_records(spark, sf_dir))


@query(f"WITH {PROJECT_SQL}, {_GOLD_SQL} SELECT count(*) AS total_gold_records, count(*) FILTER (WHERE kind = 'real') AS real_gold_records, count(*) FILTER (WHERE kind = 'controlled') AS controlled_gold_records, count(DISTINCT extension_id) AS unique_extensions, " + ", ".join(f"count(*) FILTER (WHERE label = '{n}') AS label_{n}" for n in vocab.LABELS) + " FROM gold")
def gold_set_quality(spark, sf_dir):
    return reviews.gold_set_quality(reviews.gold_set(project_records(spark, sf_dir), holdout_records(spark, sf_dir)))


@query(
    f"""WITH {PROJECT_SQL}, {_GOLD_SQL}, x AS (SELECT (SELECT count(*) FROM project) AS record_count, (SELECT count(*) FROM project WHERE label = 'risky_transition') AS risky_candidates,
      (SELECT count(*) FROM project WHERE label = 'malicious_transition') AS malicious_candidates, (SELECT count(*) FROM project WHERE label_quality_tier = 'SINGLE_REVIEWER_PROVISIONAL') AS provisional_count,
      (SELECT count(*) FROM project WHERE label = 'malicious_transition' AND label_quality_tier IN ({", ".join(f"'{n}'" for n in vocab.GOLD_TIERS)})) AS confirmed_malicious_count,
      (SELECT count(*) FROM gold WHERE kind = 'real') AS real_gold_count, (SELECT count(*) FROM gold WHERE kind = 'controlled') AS controlled_gold_count,
      (SELECT count(*) FROM project WHERE held) AS holdout_count, (SELECT count(DISTINCT extension_id) FROM project WHERE held) AS holdout_extensions,
      (SELECT count(*) FROM project WHERE held AND label_quality_tier NOT IN ({", ".join(f"'{n}'" for n in vocab.GOLD_TIERS)})) AS holdout_provisional_count,
      (SELECT count(*) FROM reviews WHERE review_round <> 'INITIAL_BLIND') AS later_reviews, true AS names_passed,
      NOT EXISTS (SELECT 1 FROM project GROUP BY record_id HAVING count(*) > 1) AS duplicates_passed,
      NOT EXISTS (SELECT 1 FROM project JOIN gold USING (record_id) WHERE project.held) AS leakage_passed),
    c AS (SELECT *, {", ".join(f"({check}) AS {name}" for name, check in audits.LAST_STAGE_CHECKS)} FROM x)
    SELECT *, array_to_string(list_filter([{", ".join(f"CASE WHEN {c} THEN '{m}' END" for c, m, _ in audits.GATES["last_stage"])}], lambda x: x IS NOT NULL), '; ') AS block_reasons, {" AND ".join(name for name, _ in audits.LAST_STAGE_CHECKS)} AS ready FROM c"""
)
def last_stage_gate(spark, sf_dir):
    """Every check and block reason of the last review stage."""
    records, holdout = project_records(spark, sf_dir), holdout_records(spark, sf_dir)
    gold = reviews.gold_set(records, holdout)
    none = lambda frame: frame.agg(F.count("*") == 0).scalar()
    counted = audits.last_stage_facts(records, gold, holdout, t.reviews(spark, sf_dir)).withColumns({
        "names_passed": F.lit(not audits.feature_name_leaks(vocab.feature_names(), vocab.STRICT_FEATURE_NAME_TERMS)),
        "duplicates_passed": none(records.groupBy("record_id").count().where("count > 1")),
        "leakage_passed": none(gold.join(holdout, "record_id", "left_semi")),
    })
    return audits.last_stage_readiness(counted).withColumn("block_reasons", F.array_join("block_reasons", "; "))


@query(f"""WITH {PROJECT_SQL}, s AS (SELECT *, CASE label WHEN 'malicious_transition' THEN 120 WHEN 'risky_transition' THEN 100 WHEN 'uncertain' THEN 90 ELSE 0 END + CASE WHEN fresh THEN 20 ELSE 0 END + CASE WHEN label_quality_tier = 'SINGLE_REVIEWER_PROVISIONAL' THEN 10 ELSE 0 END AS p FROM project)
    SELECT record_id, CAST(p AS BIGINT) AS priority_score, row_number() OVER (ORDER BY p DESC, record_id) AS rank FROM s""")
def second_review_queue(spark, sf_dir):
    """Records by second-review priority."""
    queue = reviews.second_review_queue(project_records(spark, sf_dir))
    return queue.select("record_id", C("priority_score").cast("long").alias("priority_score"), "rank")


@query(f"WITH {PROJECT_SQL}, n AS (SELECT conv_id AS record_id, count(*) AS turns FROM conversations GROUP BY 1) SELECT record_id, turns, 'benign_transition|risky_transition|malicious_transition|uncertain|excluded' AS allowed_outcomes FROM project JOIN n USING (record_id) WHERE label = 'uncertain'")
def unresolved_packets(spark, sf_dir):
    evidence = t.load(spark, sf_dir, "conversations").groupBy(C("conv_id").alias("record_id")).agg(F.count("*").alias("turns"))
    packets = reviews.unresolved_packets(project_records(spark, sf_dir), evidence)
    return packets.select("record_id", "turns", F.array_join("allowed_outcomes", "|").alias("allowed_outcomes"))


@query(f"""WITH {d.PRIORITY_SQL}, {REV.strip()} SELECT count(*) AS total_records, count(*) FILTER (WHERE {d._IS_PRIORITY_SQL}) AS review_priority_records, count(*) FILTER (WHERE label = 'benign_transition') AS benign_review_candidates,
    count(*) FILTER (WHERE label = 'risky_transition') AS risky_review_candidates, CAST(0 AS BIGINT) AS malicious_candidates, CAST(0 AS BIGINT) AS uncertain_records, count(*) FILTER (WHERE extension_id % 20 = 0) AS external_holdout_candidates,
    (SELECT count(*) FROM reviews WHERE review_round = 'INITIAL_BLIND') AS first_reviews, (SELECT count(*) FROM reviews WHERE review_round = 'SECOND_BLIND') AS second_reviews FROM prio""")
def review_summary(spark, sf_dir):
    return reviews.review_summary(d.prioritised(spark, sf_dir), t.reviews(spark, sf_dir))


@query("SELECT conv_id AS record_id, turn, 'risk_score' AS forbidden_key FROM conversations WHERE turn % 3 = 0 UNION ALL SELECT conv_id, turn, 'prediction' FROM conversations WHERE role = 'assistant'")
def forbidden_keys(spark, sf_dir):
    """Forbidden keys at any depth of JSON packets; the same words inside texts do not count."""
    inner = F.struct(C("text").alias("body"), F.when(C("turn") % 3 == 0, F.lit(1)).alias("risk_score"), F.lit('"risk_score": 1').alias("note"))
    packet = F.to_json(F.struct(F.array(inner).alias("diffs"), F.when(C("role") == "assistant", F.lit("x")).alias("prediction")))
    rows = t.load(spark, sf_dir, "conversations").select(F.struct(C("conv_id").alias("record_id"), "turn").alias("key"), packet.alias("packet"))
    found = privacy.forbidden_json_keys(rows, "packet", key="key")
    return found.select("key.record_id", "key.turn", "forbidden_key")


@query(
    "SELECT doc_id, 'text' AS place, 'email' AS violation FROM documents WHERE regexp_matches(text, '(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b') "
    "UNION ALL SELECT doc_id, 'text', 'windows_path' FROM documents WHERE regexp_matches(text, '(?i)(?:^|[\\s''\"])[A-Z]:\\\\') "
    "UNION ALL SELECT doc_id, 'text', 'private_unix_path' FROM documents WHERE regexp_matches(text, '(?:^|[\\s''\"])/(?:home|Users)/') "
    "UNION ALL SELECT doc_id, 'text', 'private_id' FROM documents WHERE regexp_matches(text, '(?i)\\b(?:human[_-]?reviewer[_-]?\\d+|reviewer0?\\d+|reviewer\\s+[AB]|adjudicator[_-]?\\d+)\\b')"
)
def private_values(spark, sf_dir):
    """Documents that hold an email address or a private path."""
    return privacy.private_values(t.load(spark, sf_dir, "documents"), ["text"], key="doc_id")


@query(f"WITH {d.LABELLED_SQL} SELECT pair_id AS record_id, added_permissions AS added, added_hosts AS hosts, true AS clean FROM labelled")
def blind_packets(spark, sf_dir):
    """Blind packets of all pairs: no forbidden key survives the allow-list."""
    # No packet field is made of files.
    evidence = d.summaries(spark, sf_dir, kinds=("permission", "host")).withColumn("record_id", C("pair_id"))
    packets = reviews.blind_packets(evidence)
    parsed = F.from_json("packet", "added_permissions array<string>, added_hosts array<string>")
    blocked = F.array(*[F.lit(name) for name in vocab.FORBIDDEN_PACKET_KEYS])
    return packets.select(
        "record_id", F.size(parsed["added_permissions"]).cast("long").alias("added"), F.size(parsed["added_hosts"]).cast("long").alias("hosts"),
        (F.size(F.array_intersect(privacy.json_keys(C("packet")), blocked)) == 0).alias("clean"),
    )


@query(f"WITH {REV}, {_KAPPA_SQL} SELECT 'cohens_kappa' AS statistic, CAST(0.5 AS DOUBLE) AS value, round((po - pe) / (1 - pe), 12) AS derived FROM kap")
def published_agreement_check(spark, sf_dir):
    """Published numbers re-derived from the cross table: only the wrong one comes back."""
    pairs = compared(spark, sf_dir).select(C("first_mapped").alias("left"), C("second_mapped").alias("right"))
    cross = metrics.label_cross_table(pairs)
    true_observed = metrics.kappa_of_cross_table(cross).select(F.lit("observed_agreement").alias("statistic"), C("observed_agreement").alias("value"))
    claimed = true_observed.unionByName(cross.agg(F.lit("cohens_kappa").alias("statistic"), F.lit(0.5).alias("value")))
    return metrics.check_published_agreement(claimed, cross).withColumn("derived", F.round("derived", 12))


# -- models -----------------------------------------------------------------
def _training_rows(spark, sf_dir):
    return d.stored_features(spark, sf_dir)


_SEEN_SQL = d.LABELLED_SQL + ", seen AS (SELECT pair_id, split, CASE label WHEN 'risky_transition' THEN 1 ELSE 0 END AS target FROM labelled WHERE eligible)"
_FORESTS, _REGRESSIONS = "random_forest", "logistic_regression"


def _grid_sql(model: str) -> str:
    """The grid of a model as a table of candidate numbers and parameters."""
    return ", ".join(f"({at}, '{json.dumps(params)}')" for at, params in enumerate(models.candidates(model)))


def _consistent() -> Column:
    """Metrics as they follow from the four counts, and all in their range."""
    tn, fp, fn, tp = (C(name).cast("double") for name in ("tn", "fp", "fn", "tp"))
    expected = {
        "accuracy": (tp + tn) / (tp + tn + fp + fn), "recall": tp / (tp + fn), "specificity": tn / (tn + fp),
        "balanced_accuracy": (tp / (tp + fn) + tn / (tn + fp)) / 2, "f1": F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)),
    }
    checks = [(F.abs(C(name) - value) < 1e-6) & C(name).between(0, 1) for name, value in expected.items()]
    return reduce(lambda left, right: left & right, checks)


def _candidate_facts(table):
    """What SQL can say about validation results: candidates with their parameters, rows and positives, and metrics that follow from the counts."""
    described = table.sparkSession.createDataFrame([(model, at, json.dumps(params), str(params)) for model in (_FORESTS, _REGRESSIONS) for at, params in enumerate(models.candidates(model))],
                                                   "model string, candidate int, parameters string, params string")
    records = (C("tn") + C("fp") + C("fn") + C("tp")).alias("records")
    return table.join(described, ["model", "candidate", "params"]).select("candidate", "parameters", records, (C("fn") + C("tp")).alias("positives"), _consistent().alias("consistent"))


def _candidate_sql(model: str) -> str:
    return f"WITH {_SEEN_SQL} SELECT candidate, parameters, count(*) AS records, CAST(sum(target) AS BIGINT) AS positives, true AS consistent FROM seen, (VALUES {_grid_sql(model)}) AS g(candidate, parameters) WHERE split = 'validation' GROUP BY ALL"


@query(_candidate_sql(_REGRESSIONS))
def logistic_selection(spark, sf_dir):
    """Validation results of the logistic-regression grid."""
    _, table, _, _ = models.train_and_select(_training_rows(spark, sf_dir), vocab.feature_names(vocab.MANIFEST_PERMISSION), _REGRESSIONS)
    return _candidate_facts(table)


@query(_candidate_sql(_FORESTS))
def forest_selection(spark, sf_dir):
    """Validation results of the random-forest grid."""
    _, table, _, _ = models.train_and_select(_training_rows(spark, sf_dir), vocab.feature_names(vocab.PERMISSION_ONLY), _FORESTS)
    return _candidate_facts(table)


@query("SELECT CAST(unnest(range(1, 11)) AS INT) AS rank, true AS known, true AS descending")
def logistic_weights(spark, sf_dir):
    """Largest coefficients of the chosen logistic regression: ten features of the projection, by size."""
    names = vocab.feature_names(vocab.MANIFEST_PERMISSION)
    _, _, _, fitted = models.train_and_select(_training_rows(spark, sf_dir), names, _REGRESSIONS)
    order = Window.orderBy(F.desc(F.abs("weight")), "feature")
    top = models.top_weights(fitted, spark).select("feature", "weight", F.row_number().over(order).alias("rank"), F.lag(F.abs("weight")).over(order).alias("above"))
    return top.select("rank", C("feature").isin(names).alias("known"), F.coalesce(F.abs("weight") <= C("above"), F.lit(True)).alias("descending"))


@query(f"WITH {_SEEN_SQL} SELECT pair_id AS record_id, target AS truth, true AS follows_score, true AS in_range FROM seen WHERE split = 'test'")
def forest_predictions(spark, sf_dir):
    """Test predictions of the random forest chosen from its grid: every test row once, with a score and what follows from it."""
    test, _, _, _ = models.train_and_select(_training_rows(spark, sf_dir), vocab.feature_names(vocab.PERMISSION_ONLY), _FORESTS)
    return test.select("record_id", "truth", (C("predicted") == (C("score") > 0.5).cast("int")).alias("follows_score"), C("score").between(0, 1).alias("in_range"))


def _family_sql() -> str:
    names = vocab.feature_names(vocab.MANIFEST_PERMISSION)
    rows = []
    for family in vocab.ABLATION_FAMILIES:
        kept = len(features.without_family(names, family))
        status = "completed" if 0 < kept < len(names) else "no_matching_features_removed" if kept else "not_run_all_features_removed"
        rows.append(f"('{family}', '{status}', {kept}, {'true' if kept else 'false'})")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS f(family_removed, status, remaining_feature_count, measured)"


@query(_family_sql())
def family_importance(spark, sf_dir):
    """Metric change of the logistic regression without each feature family; measured: each change is the difference of its metrics."""
    rows, names = _training_rows(spark, sf_dir), vocab.feature_names(vocab.MANIFEST_PERMISSION)
    _, _, chosen, _ = models.train_and_select(rows, names, _REGRESSIONS)
    changes = [F.abs(C(name) - C(f"base_{name}") - C(f"delta_{name}")) < 1e-6 for name in ("f1", "recall", "false_positive_rate", "balanced_accuracy")]
    measured = F.coalesce(reduce(lambda left, right: left & right, changes), F.lit(False))
    return models.ablation_study(rows, names, chosen).select("family_removed", "status", "remaining_feature_count", measured.alias("measured"))


_EXPERIMENTS = ", ".join([*(f"('{model}', '{name}')" for name in vocab.PROJECTIONS for model in (_REGRESSIONS, _FORESTS)), f"('rule_engine', '{vocab.FULL_DIFFERENTIAL}')"])


@query(f"WITH {_SEEN_SQL} SELECT model, feature_set, count(*) AS records, CAST(sum(target) AS BIGINT) AS positives, true AS consistent FROM seen, (VALUES {_EXPERIMENTS}) AS e(model, feature_set) WHERE split = 'test' GROUP BY ALL")
def model_experiment(spark, sf_dir):
    """Models, each chosen from its grid, on all projections and the score, side by side."""
    from deltascope.plans import experiment

    table, _ = experiment.run(_training_rows(spark, sf_dir))
    areas = F.coalesce(C("roc_auc").between(0, 1) & C("pr_auc").between(0, 1), F.lit(False))
    return table.select("model", "feature_set", (C("tn") + C("fp") + C("fn") + C("tp")).alias("records"), (C("fn") + C("tp")).alias("positives"), (_consistent() & areas).alias("consistent"))
