"""A registry of stages, and a runner that skips what hasn't changed since its last run."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "stage string, unit string, inputs map<string,string>, config string, outputs array<string>, version string, at string"


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[..., Any]
    inputs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()
    per_play: bool = False
    version: str = "1"


@dataclass
class Registry:
    stages: dict[str, Stage] = field(default_factory=dict)

    def stage(self, name: str, inputs: Sequence[str] = (), outputs: Sequence[str] = (), per_play: bool = False, version: str = "1"):
        """Registers a function under a name, with path templates such as '{root}/pbp/{game_key}'."""
        def add(run: Callable[..., Any]) -> Callable[..., Any]:
            if name in self.stages:
                raise ValueError(f"there is a stage {name}")
            self.stages[name] = Stage(name, run, tuple(inputs), tuple(outputs), per_play, version)
            return run

        return add


def config_hash(config: Mapping[str, Any]) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def fingerprints(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """For each path that exists, its files' sizes and times in one hash; found by Hadoop's own file systems, whatever the store."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), {}
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(conf)
        if not fs.exists(at):
            continue
        if fs.getFileStatus(at).isDirectory():
            files, it = [], fs.listFiles(at, True)
            while it.hasNext():
                files.append(it.next())
        else:
            files = [fs.getFileStatus(at)]
        facts = sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in files)
        out[path] = hashlib.sha256(json.dumps(facts).encode()).hexdigest()
    return out


def empty_manifest(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MANIFEST)


def outcome(manifest: Mapping[tuple[str, str], Mapping[str, Any]], stage: Stage, unit: str, found: Mapping[str, str], wanted: Sequence[str],
    outputs_there: bool, config: str, force: bool = False) -> str:
    """run, skipped or missing."""
    if set(wanted) - set(found):
        return "missing"
    old = manifest.get((stage.name, unit))
    same = old and (dict(old["inputs"] or {}), old["config"], old["version"]) == (dict(found), config, stage.version) and outputs_there
    return "skipped" if same and not force else "run"


def run_stages(spark: SparkSession, registry: Registry, units: Sequence[Mapping[str, str]], manifest: DataFrame, config: Mapping[str, Any], at: str,
    force: bool = False, dry: bool = False) -> tuple[DataFrame, DataFrame]:
    """(the new manifest, what was done: stage, unit, action). A stage's function gets (spark, unit, config). Missing inputs are
    reported, not raised, and stop nothing else."""
    known = {(r["stage"], r["unit"]): r.asDict() for r in manifest.collect()}
    done, key = [], config_hash(config)
    for stage in registry.stages.values():
        for unit in units:
            if stage.per_play != ("play_uid" in unit):
                continue
            name = unit.get("play_uid") or unit.get("game_key", "")
            wanted, outputs = ([t.format(**unit) for t in templates] for templates in (stage.inputs, stage.outputs))
            found = fingerprints(spark, wanted)
            action = outcome(known, stage, name, found, wanted, len(fingerprints(spark, outputs)) == len(outputs), key, force)
            if action == "run" and not dry:
                stage.run(spark, dict(unit), dict(config))
                known[stage.name, name] = {"stage": stage.name, "unit": name, "inputs": found, "config": key, "outputs": outputs,
                    "version": stage.version, "at": at}
            done.append((stage.name, name, "would run" if action == "run" and dry else action))
    rows = [tuple(known[k][c] for c in ("stage", "unit", "inputs", "config", "outputs", "version", "at")) for k in sorted(known)]
    return spark.createDataFrame(rows, MANIFEST), spark.createDataFrame(done, "stage string, unit string, action string")


def action_counts(done: DataFrame) -> DataFrame:
    return done.groupBy("action").agg(F.count("*").alias("n"))
