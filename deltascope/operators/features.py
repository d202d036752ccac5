"""Numeric feature table of pairs and its projections."""
from pyspark.sql import Column, DataFrame, functions as F

from deltascope import vocab
from deltascope.functions.numbers import flag

C = F.col


def feature_columns() -> dict[str, Column]:
    """The feature values, over the columns of a drift summary."""
    delta = lambda name: C(f"new_{name}") - C(f"old_{name}")
    available = lambda name: flag(
        ~F.exists("failed_analyzers", lambda item: item["analyzer"] == name)
    )
    values = {
        "added_permission_count": C("added_permission_count"),
        "removed_permission_count": C("removed_permission_count"),
        "added_sensitive_permission_count": C("added_sensitive_permission_count"),
        "removed_sensitive_permission_count": C("removed_sensitive_permission_count"),
        "permission_risk_delta": C("added_permission_risk_score"),
        "critical_permission_added": flag(C("critical_permission_added")),
        "high_permission_added": flag(C("high_permission_added")),
        "optional_permission_change_count": C("optional_permission_change_count"),
        "host_count_delta": delta("host_count"),
        "added_host_count": C("added_host_count"),
        "host_scope_score_delta": C("host_scope_score_delta"),
        "wildcard_host_introduced": flag(C("wildcard_host_introduced")),
        "all_urls_introduced": flag(C("global_host_expansion")),
        "content_script_changed": flag(C("content_scripts_changed")),
        "service_worker_introduced": flag(C("background_added")),
        "externally_connectable_changed": flag(C("externally_connectable_changed")),
        "web_accessible_resource_change_count": C("web_accessible_resource_change_count"),
        "csp_changed": flag(C("csp_changed")),
        "v2_total_permission_count": C("new_permission_count"),
        "v2_sensitive_permission_count": C("new_sensitive_permission_count"),
        "v2_total_host_count": C("new_host_count"),
        "v2_wildcard_host_count": C("new_wildcard_host_count"),
        "v2_all_urls_present": flag(C("new_has_global_host")),
        "v2_service_worker_present": flag(C("new_background_present")),
        "v2_sensitive_api_count": C("new_api_count"),
        "v2_external_domain_count": C("new_external_endpoint_total"),
        "v2_http_endpoint_count": C("new_http_endpoint_total"),
        "v2_hardcoded_ip_count": C("new_ip_total"),
        "v2_obfuscation_indicator_count": C("new_obfuscation_count"),
        "v2_dynamic_execution_count": C("new_dynamic_execution_count"),
        "v2_function_count": C("new_function_count"),
        "v2_source_sink_indicator_count": C("source_sink_flow_count"),
        "permission_count_delta": delta("permission_count"),
        "file_count_delta": delta("file_count"),
        "package_size_delta_bytes": C("size_delta_bytes"),
        "js_file_count_delta": delta("script_count"),
        "api_count_delta": delta("api_count"),
        "network_destination_count_delta": delta("network_count"),
        "obfuscation_count_delta": delta("obfuscation_count"),
        "function_count_delta": delta("function_count"),
        "added_api_count": C("added_api_count"),
        "critical_api_added": flag(C("max_added_api_severity") == "Critical"),
        "new_external_network_count": C("new_external_count"),
        "new_local_network_count": C("new_local_count"),
        "plain_http_addition_count": C("plain_http_addition_count"),
        "decoded_endpoint_addition_count": C("decoded_endpoint_count"),
        "hardcoded_ip_addition_count": C("hardcoded_ip_addition_count"),
        "added_obfuscation_score": C("added_obfuscation_score"),
        "dynamic_execution_added_count": C("dynamic_execution_added_count"),
        "added_function_count": C("added_function_count"),
        "added_event_listener_count": C("added_listener_count"),
        "source_sink_flow_count": C("source_sink_flow_count"),
        "modified_file_count": C("modified_file_count"),
    }
    values.update({f"{name}_available": available(name) for name in vocab.ANALYZERS})
    return {name: F.coalesce(values[name].cast("double"), F.lit(0.0)) for name in vocab.feature_names()}


def metadata_columns(pairs: DataFrame) -> list[Column]:
    """The descriptive columns of a feature row; columns a pair table lacks are null."""
    have = lambda name: C(name) if name in pairs.columns else F.lit(None).cast("string")
    source_type = have("source_type")
    derived = {
        "record_id": C("pair_id"),
        "provenance_id": F.concat_ws(":", source_type, C("pair_id")),
        "is_controlled": F.coalesce(have("controlled_mutation_type") != "", F.lit(False))
        | F.coalesce(source_type == "controlled", F.lit(False)),
        "eligible_for_supervised_training": have("eligible_for_supervised_training").cast("boolean"),
    }
    return [derived.get(name, have(name)).alias(name) for name in vocab.METADATA_COLUMNS]


def feature_table(pairs: DataFrame, summary: DataFrame) -> DataFrame:
    """Metadata plus all feature columns, one row per pair."""
    features = summary.select("pair_id", *[column.alias(name) for name, column in feature_columns().items()])
    described = pairs.select("pair_id", *[column.alias(f"_{name}") for name, column in zip(vocab.METADATA_COLUMNS, metadata_columns(pairs))])
    joined = described.join(features, "pair_id", "left")
    return joined.select(
        *[C(f"_{name}").alias(name) for name in vocab.METADATA_COLUMNS],
        # A pair without any fact has zero drift, which is not the same as a failed analyser.
        *[F.coalesce(name, F.lit(1.0 if name.endswith("_available") else 0.0)).alias(name) for name in vocab.feature_names()],
    )


def projection(features: DataFrame, name: str) -> DataFrame:
    """Metadata plus the feature columns of one named projection."""
    return features.select(
        *[column for column in vocab.METADATA_COLUMNS if column in features.columns], *vocab.feature_names(name)
    )


def without_family(names: list[str], family: str) -> list[str]:
    """Feature names left after one ablation family is taken out."""
    if family not in vocab.ABLATION_FAMILIES:
        raise ValueError(f"unknown ablation family: {family}")
    terms = vocab.ABLATION_FAMILIES[family]
    return [name for name in names if not any(term in name.lower() for term in terms)]


def ablate(features: DataFrame, family: str) -> DataFrame:
    names = [name for name in features.columns if name not in vocab.METADATA_COLUMNS]
    kept = [name for name in features.columns if name in vocab.METADATA_COLUMNS]
    return features.select(*kept, *without_family(names, family))


def supervised(rows: DataFrame) -> DataFrame:
    """Rows that are eligible and carry a label of the binary target."""
    eligible = F.lower(C("eligible_for_supervised_training").cast("string")) == "true"
    return rows.where(eligible & C("label").isin(list(vocab.TARGET_MAPPING)))


def binary_label(label: Column) -> Column:
    """0 / 1 target of a label; another label is an error."""
    ones = [name for name, value in vocab.BINARY_LABELS.items() if value]
    zeros = [name for name, value in vocab.BINARY_LABELS.items() if not value]
    return (
        F.when(label.isin(zeros), 0)
        .when(label.isin(ones), 1)
        .otherwise(
            F.raise_error(F.concat(F.lit("label is not binary-evaluable: "), F.coalesce(label, F.lit("null")))).cast("int")
        )
    )
