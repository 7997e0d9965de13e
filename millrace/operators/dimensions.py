"""Dimension tables of pods and nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_filled(source: Column, names: list[str], *others: Column) -> Column:
    """The first label of names that is not empty, or else the first of the other columns."""
    return F.coalesce(*[F.nullif(source[n], F.lit("")) for n in names], *[F.nullif(c, F.lit("")) for c in others])


def pod_tags(pods: DataFrame, app_labels: list[str], hostname_label: str = "hostname") -> DataFrame:
    """namespace, pod, ip, app, hostname of pods (namespace, name, ip, labels, spec_hostname)."""
    return pods.select("namespace", F.col("name").alias("pod"), "ip", first_filled(F.col("labels"), app_labels).alias("app"), first_filled(F.col("labels"), [hostname_label], F.col("spec_hostname"), F.col("name")).alias("hostname"))


def env_value(env: Column, name: str) -> Column:
    """The value of an environment entry (array<struct<name, value>>)."""
    return F.get(F.filter(env, lambda e: e["name"] == name), F.lit(0))["value"]


def main_container(containers: Column, sidecars: list[str], sidecar_env: str = "") -> Column:
    """The only container, else the first that is no sidecar by name or environment, else the first."""

    def plain(c: Column) -> Column:
        marked = F.exists(F.coalesce(c["env"], F.array().cast("array<struct<name:string,value:string>>")), lambda e: e["name"] == sidecar_env) if sidecar_env else F.lit(False)
        return ~(c["name"].isin(sidecars) | marked)

    return F.when(F.size(containers) == 1, containers[0]).otherwise(F.coalesce(F.get(F.filter(containers, plain), F.lit(0)), F.get(containers, F.lit(0))))


#: Node labels by tag.
NODE_LABELS = {"region": "topology.kubernetes.io/region", "zone": "topology.kubernetes.io/zone", "os": "kubernetes.io/os", "arch": "kubernetes.io/arch", "instance_type": "node.kubernetes.io/instance-type"}


def node_tags(nodes: DataFrame) -> DataFrame:
    return nodes.select("name", *[F.col("labels")[label].alias(tag) for tag, label in NODE_LABELS.items()])


def full_sync(resources: DataFrame) -> DataFrame:
    """What replaces a type: all but terminated nodes and finished pods."""
    gone = ((F.col("type") == "node") & F.coalesce(F.col("terminated"), F.lit(False))) | ((F.col("type") == "pod") & F.col("phase").isin("Succeeded", "Failed"))
    return resources.filter(~F.coalesce(gone, F.lit(False)))


def gone() -> Column:
    """True for the event of a resource that was deleted or has finished."""
    return (F.col("event") == "delete") | F.col("phase").isin("Succeeded", "Failed")


def delta_events(events: DataFrame, interval: str = "3 seconds", key: tuple[str, ...] = ("namespace", "name")) -> DataFrame:
    """The last event of each resource and interval, with action del for deleted or finished ones and add for others.

    Events without a time are a batch of their own, without a start.
    """
    # A window leaves out rows without a time; these pass it under another one.
    start = F.when(F.col("ts").isNotNull(), F.window(F.coalesce("ts", F.timestamp_seconds(F.lit(0))), interval)["start"])
    last = events.withColumn("batch", start).groupBy("batch", *key).agg(F.max_by(F.struct(*events.columns), F.struct("ts", "seq")).alias("e"))
    return last.select("batch", "e.*").withColumn("action", F.when(F.coalesce(gone(), F.lit(False)), "del").otherwise("add"))


def apply_delta(snapshot: DataFrame, delta: DataFrame, key: tuple[str, ...] = ("namespace", "name")) -> DataFrame:
    """The snapshot after a delta: changed resources are replaced, deleted ones go."""
    newest = Window.partitionBy(*key).orderBy(F.col("batch").desc())
    last = delta.withColumn("rank", F.row_number().over(newest)).filter("rank = 1")
    rest = snapshot.join(last, list(key), "left_anti")
    return rest.unionByName(last.filter("action = 'add'").select(*snapshot.columns))


def task_tags(targets: DataFrame, refs: dict[str, str]) -> DataFrame:
    """targets (meta, labels, annotations MAPs) with tags: each reference is labels.x, annotations.x or a meta name."""

    def value(ref: str) -> Column:
        kind, _, rest = ref.partition(".")
        return F.col(kind)[rest] if rest and kind in ("labels", "annotations") else F.col("meta")[ref]

    pairs = F.array(*[F.struct(F.lit(tag).alias("k"), F.coalesce(value(ref), F.lit("")).alias("v")) for tag, ref in refs.items()])
    return targets.withColumn("tags", F.map_from_entries(pairs))
