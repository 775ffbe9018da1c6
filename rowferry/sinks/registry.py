"""Targets by name. A sink is any callable ``(mapped, spec, config) -> None``.

Writers use Spark's own data sources. Kafka and search-index connectors are not
part of Spark's core: when the class path lacks them the write fails with Spark's
message, or goes to files when the config names a ``path``.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowferry.operators.delivery import call_with_retry, deliver_in_place
from rowferry.sinks import frames
from rowferry.sources.jdbc import jdbc_options
from rowferry.spec import SyncOptions, SyncSpec
from rowferry.storage import control_rows, new_folder

Sink = Callable[[DataFrame, SyncSpec, Mapping[str, Any]], None]

_sinks: dict[str, Sink] = {}
_repeatable: dict[str, Callable[[Mapping[str, Any]], bool]] = {}
_keep_progress: set[str] = set()

# Config entries that steer the writer and are not passed on as options.
_OWN = ("path", "index", "topic", "mode", "codec", "run_id")


def register_sink(
    name: str, sink: Sink, *, repeatable: Callable[[Mapping[str, Any]], bool] = lambda config: False
) -> None:
    """Register a sink. ``repeatable`` says whether a failed write may simply be run
    again: only then is the whole write retried (Spark retries single tasks anyway)."""
    _sinks[name.strip().upper()] = sink
    _repeatable[name.strip().upper()] = repeatable


def register_sender(name: str, make: Callable[[Mapping[str, Any]], Callable[[pa.Table], object]]) -> None:
    """Register a target that takes Arrow tables: ``make(config)`` gives what sends one.

    Rows are sent from the partitions they lie in, ``batch_size`` at a time. Each batch is retried
    by itself with the options' count and waits; batches that a run delivered are passed over when
    the run is finished later. A run keeps that record in its state folder.
    """

    def write(mapped: DataFrame, spec: SyncSpec, config: Mapping[str, Any]) -> None:
        progress = config.get("progress") or new_folder(mapped.sparkSession, "progress")
        own = {k: v for k, v in config.items() if k != "progress"}
        outcomes = deliver_in_place(mapped, make(own), spec.options, key=spec.checkpoint.target, progress=progress)
        lost = outcomes.where(~F.col("delivered"))
        totals = lost.agg(F.count(F.lit(1)).alias("lost"), F.min("error").alias("error")).first()
        if totals["lost"]:
            raise BatchesLost(f"{totals['lost']} batches were not taken: {totals['error']}")

    register_sink(name, write)
    _keep_progress.add(name.strip().upper())


class BatchesLost(RuntimeError):
    """Some batches stayed undelivered after their retries; the others have arrived and are on record."""


def find_sink(name: str | None) -> Sink:
    """The sink of a target type, regardless of case; an unknown type is an error."""
    sink = _sinks.get((name or "").strip().upper())
    if sink is None:
        raise ValueError(f"unsupported target type: {name}")
    return sink


def sink_names() -> list[str]:
    return sorted(_sinks)


def _rest(config: Mapping[str, Any]) -> dict[str, str]:
    return {k: str(v) for k, v in config.items() if k not in _OWN}


def write_files(mapped: DataFrame, spec: SyncSpec, config: Mapping[str, Any], fmt: str = "parquet") -> None:
    """Files under ``path``. With a ``run_id`` the run owns one partition and replaces
    it when repeated, so a retried or replayed run leaves the same rows."""
    writer, path = mapped.write, config["path"]
    if config.get("codec"):
        writer = writer.option("compression", str(config["codec"]))
    if config.get("run_id"):
        writer.mode("overwrite").format(fmt).options(**_rest(config)).save(f"{path}/run_id={config['run_id']}")
    else:
        writer.mode(config.get("mode", "append")).format(fmt).options(**_rest(config)).save(path)


def write_jdbc(mapped: DataFrame, spec: SyncSpec, config: Mapping[str, Any]) -> None:
    """Append through JDBC: batches of ``batch_size`` in one transaction per task.

    Plain inserts, at least once: a task that is run again inserts again, so keep
    ``spark.speculation`` off. ``numPartitions`` bounds the open connections.
    """
    options = jdbc_options({k: v for k, v in config.items() if k not in _OWN}, spec.target_table)
    options.pop("fetchsize", None)
    options.setdefault("batchsize", str(spec.options.batch_size))
    mapped.write.format("jdbc").mode("append").options(**options).save()


# Names of producer settings in a target config, what they are called
# as writer options, and their defaults.
PRODUCER = {
    "bootstrapServers": "kafka.bootstrap.servers",
    "producer-batch-size": "kafka.batch.size",
    "producer-linger-ms": "kafka.linger.ms",
    "producer-acks": "kafka.acks",
    "producer-retries": "kafka.retries",
    "producer-enable-idempotence": "kafka.enable.idempotence",
}
PRODUCER_DEFAULTS = {
    "kafka.batch.size": "16384",
    "kafka.linger.ms": "5",
    "kafka.acks": "all",
    "kafka.retries": "3",
    "kafka.enable.idempotence": "true",
}
PRODUCER_SECURITY = {
    "security-protocol": "kafka.security.protocol",
    "sasl-mechanism": "kafka.sasl.mechanism",
    "sasl-jaas-config": "kafka.sasl.jaas.config",
    "ssl-truststore-location": "kafka.ssl.truststore.location",
    "ssl-truststore-password": "kafka.ssl.truststore.password",
    "ssl-keystore-location": "kafka.ssl.keystore.location",
    "ssl-keystore-password": "kafka.ssl.keystore.password",
    "ssl-endpoint-identification-algorithm": "kafka.ssl.endpoint.identification.algorithm",
}


def kafka_options(config: Mapping[str, Any]) -> dict[str, str]:
    """Writer options of a message target: named settings are translated, ``kafka.*``
    entries pass through, security settings count under SASL_SSL only."""
    names = dict(PRODUCER)
    out = dict(PRODUCER_DEFAULTS)
    if config.get("security-protocol") == "SASL_SSL":
        names.update(PRODUCER_SECURITY)
        out |= {"kafka.sasl.mechanism": "PLAIN", "kafka.ssl.endpoint.identification.algorithm": ""}
    out |= {names[k]: str(v) for k, v in config.items() if k in names and v is not None}
    return out | {k: str(v) for k, v in config.items() if k.startswith("kafka.")}


def index_options(config: Mapping[str, Any]) -> dict[str, str]:
    """Connector options of a search-index target (``clusterNodes``, ``username``, ...)."""
    names = {
        "clusterNodes": "es.nodes",
        "username": "es.net.http.auth.user",
        "password": "es.net.http.auth.pass",
    }
    out = {"es.nodes": "localhost:9200"}
    out |= {names[k]: str(v) for k, v in config.items() if k in names and v}
    return out | {k: str(v) for k, v in config.items() if k.startswith("es.")}


def write_kafka(mapped: DataFrame, spec: SyncSpec, config: Mapping[str, Any]) -> None:
    """Message records to Kafka, or to JSON files when the config names a ``path``."""
    records = frames.kafka_records(mapped, spec, config.get("topic"))
    if config.get("path"):
        records.write.mode("append").json(config["path"])
    else:
        records.write.format("kafka").options(**kafka_options(config)).save()


def write_index(mapped: DataFrame, spec: SyncSpec, config: Mapping[str, Any]) -> None:
    """Documents to a search index through its connector, or as bulk text files with the
    index mapping in ``<path>_mapping`` beside them."""
    documents = frames.index_documents(mapped, spec, config.get("index"))
    if config.get("path"):
        mapping = control_rows(mapped.sparkSession, [{"value": frames.index_mapping_json(spec)}], "value string")
        mapping.write.mode("overwrite").text(f"{config['path'].rstrip('/')}_mapping")
        frames.bulk_lines(documents).write.mode("append").text(config["path"])
        return
    options = index_options(config)
    if spec.id_field:
        options["es.mapping.id"] = spec.id_field.target
    index = config.get("index") or spec.target_table
    mapped.write.format("org.elasticsearch.spark.sql").mode("append").options(**options).save(index)


register_sink("JDBC", write_jdbc)
register_sink("KAFKA", write_kafka)
register_sink("ELASTICSEARCH", write_index)


def _owns_folder(config: Mapping[str, Any]) -> bool:
    return bool(config.get("run_id"))


register_sink(
    "PARQUET", lambda mapped, spec, config: write_files(mapped, spec, config, "parquet"), repeatable=_owns_folder
)
register_sink("JSON", lambda mapped, spec, config: write_files(mapped, spec, config, "json"), repeatable=_owns_folder)


@dataclass(frozen=True)
class Target:
    """One place a sync delivers to."""

    kind: str
    config: Mapping[str, Any]
    name: str = ""


@dataclass(frozen=True)
class TargetOutcome:
    name: str
    attempts: int
    waited_ms: int
    error: str | None

    @property
    def delivered(self) -> bool:
        return self.error is None


def fan_out(
    mapped: DataFrame,
    spec: SyncSpec,
    targets: Sequence[Target],
    options: SyncOptions | None = None,
    *,
    run_id: str | None = None,
    progress: str | None = None,
    done: Collection[int] = (),
    on_done: Callable[[int], None] | None = None,
) -> list[TargetOutcome]:
    """Write the same rows to every target in turn, each with its own retries where
    its write can be repeated without leaving rows twice.

    A target that fails does not make the ones before it write again, and the ones
    after it are not tried. Sinks are looked up first, so an unknown type fails
    before anything is written. Targets numbered in ``done`` have the rows already and
    are passed over; ``on_done`` hears of every other one that gets them.
    """
    writers = [(t, find_sink(t.kind)) for t in targets]
    outcomes: list[TargetOutcome] = []
    for number, (target, sink) in enumerate(writers):
        if number in done:
            continue
        config = dict(target.config)
        if run_id and target.kind.strip().upper() in ("PARQUET", "JSON"):
            config.setdefault("run_id", run_id)
        if progress and target.kind.strip().upper() in _keep_progress:
            config.setdefault("progress", f"{progress}/target={number}")
        knobs = options or spec.options
        if not _repeatable[target.kind.strip().upper()](config):
            knobs = replace(knobs, max_retries=0)
        attempts, waited, error = call_with_retry(
            lambda sink=sink, config=config: sink(mapped, spec, config), knobs
        )
        outcomes.append(TargetOutcome(target.name or target.kind.upper(), attempts, waited, error))
        if error is not None:
            break
        if on_done is not None:
            on_done(number)
    return outcomes
