"""Relabelling rules over a label map."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    action: str = "replace"
    source_labels: tuple[str, ...] = ()
    regex: str = "(.*)"
    target_label: str = ""
    replacement: str = "$1"
    separator: str = ";"


# Meta labels of the pod discovery and the rules applied to them.
MIRROR = "__meta_kubernetes_pod_annotation_kubernetes_io_config_mirror"
SCRAPE = "__meta_kubernetes_pod_annotation_prometheus_io_scrape"
CONTAINER = "__meta_kubernetes_pod_container_name"
POD = "__meta_kubernetes_pod_name"
NAMESPACE = "__meta_kubernetes_namespace"
UID = "__meta_kubernetes_pod_uid"

POD_RULES = (
    Rule("drop", (MIRROR,), "mirror"),
    Rule("keep", (SCRAPE,), "true"),
    Rule("replace", (CONTAINER,), target_label="container"),
    Rule("replace", (POD,), target_label="pod"),
    Rule("replace", (NAMESPACE,), target_label="namespace"),
    Rule("replace", (POD,), target_label="instance"),
    Rule("replace", (CONTAINER,), target_label="job"),
    Rule("replace", (UID, CONTAINER), target_label="__path__",
         replacement="/var/log/pods/*$1/*.log", separator="/"),
)


ANYTHING = "(.*)"


def _replaced(value: Column, rule: Rule) -> Column:
    """Replacement text for a matching value."""
    if rule.regex == ANYTHING:
        # the group is the whole value
        before, _, after = rule.replacement.partition("$1")
        return F.concat(F.lit(before), value, F.lit(after)) if "$1" in rule.replacement else F.lit(before)
    return F.regexp_replace(value, f"^(?s:{rule.regex})$", re.sub(r"\$\{(\w+)\}", r"$\1", rule.replacement))


def relabel(df: DataFrame, rules=POD_RULES, labels: str = "labels") -> DataFrame:
    """Apply the rules in order.  A pattern must match the whole joined value.

    A missing label reads as ''; a replacement that comes out empty removes the target.
    New labels are kept as expressions while the rules are gone through, so the map is
    rebuilt only once.
    """
    new: dict[str, Column] = {}

    def read(name: str) -> Column:
        return new[name] if name in new else F.col(labels)[name]

    for rule in rules:
        parts = [F.coalesce(read(name), F.lit("")) for name in rule.source_labels]
        value = F.concat_ws(rule.separator, *parts) if parts else F.lit("")
        matched = None if rule.regex == ANYTHING else value.rlike(f"^(?s:{rule.regex})$")
        if rule.action == "replace":
            replaced = F.nullif(_replaced(value, rule), F.lit(""))
            if matched is not None:
                replaced = F.when(matched, replaced).otherwise(read(rule.target_label))
            new[rule.target_label] = replaced
        elif rule.action == "keep":
            df = df.filter(F.lit(True) if matched is None else matched)
        elif rule.action == "drop":
            df = df.filter(F.lit(False) if matched is None else ~matched)
        else:
            raise ValueError(f"unknown action {rule.action!r}")
    if not new:
        return df
    untouched = F.map_filter(labels, lambda key, _: ~key.isin(*new))
    pairs = [c for name, value in new.items() for c in (F.lit(name), value)]
    added = F.map_filter(F.create_map(*pairs), lambda _, value: value.isNotNull())
    return df.withColumn(labels, F.map_concat(untouched, added))
