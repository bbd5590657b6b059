"""Named rulesets, recipes, profiles and models on disk; an audit trail; background jobs."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabguard.errors import TableError, need
from tabguard.operators.recipe import validate_recipe
from tabguard.operators.reconcile import PROFILE_KEYS
from tabguard.operators.validate import RULESETS, resolve_ruleset

KINDS = ("rulesets", "recipes", "profiles")
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9 _.-]{0,63}")


class Workspace:
    """A folder of JSON files; the names can't leave it."""

    def __init__(self, root: str):
        self.root = Path(root)
        for kind in (*KINDS, "models"):
            (self.root / kind).mkdir(parents=True, exist_ok=True)

    def _path(self, kind: str, name: str) -> Path:
        need(kind, KINDS, "kind")
        if not _NAME.fullmatch(name) or ".." in name:
            raise TableError(f"{name!r} is no valid name: letters, digits, space, _ . - only")
        return self.root / kind / f"{name}.json"

    def save(self, kind: str, name: str, value: dict) -> None:
        path = self._path(kind, name)
        if kind == "rulesets":
            if name in RULESETS:
                raise TableError(f"{name!r} is built in and can't be changed")
            resolve_ruleset(value)
        elif kind == "recipes":
            validate_recipe(value)
        else:
            if not value.get("keys"):
                raise TableError("a profile needs keys")
            for key in value:
                need(key, PROFILE_KEYS, "profile key")
        path.write_text(json.dumps(value, indent=1))
        self.record(f"save_{kind}", {"name": name})

    def get(self, kind: str, name: str) -> dict:
        if kind == "rulesets" and name in RULESETS:
            return RULESETS[name]
        path = self._path(kind, name)
        need(name, self.names(kind), kind[:-1])
        return json.loads(path.read_text())

    def delete(self, kind: str, name: str) -> None:
        if kind == "rulesets" and name in RULESETS:
            raise TableError(f"{name!r} is built in and can't be deleted")
        path = self._path(kind, name)
        need(name, self.names(kind), kind[:-1])
        path.unlink()
        self.record(f"delete_{kind}", {"name": name})

    def names(self, kind: str) -> list[str]:
        need(kind, KINDS, "kind")
        own = sorted(p.stem for p in (self.root / kind).glob("*.json"))
        return [*RULESETS, *own] if kind == "rulesets" else own

    def rulesets(self) -> dict[str, dict]:
        return {n: self.get("rulesets", n) for n in self.names("rulesets") if n not in RULESETS}

    @property
    def models(self) -> str:
        return str(self.root / "models")

    def record(self, action: str, details: dict) -> None:
        line = {"time": datetime.now(timezone.utc).isoformat(), "action": action, **details}
        with (self.root / "audit.jsonl").open("a") as f:
            f.write(json.dumps(line, default=str) + "\n")

    def history(self, n: int = 50, action: str | None = None) -> list[dict]:
        path = self.root / "audit.jsonl"
        lines = [json.loads(x) for x in path.read_text().splitlines()] if path.exists() else []
        return [x for x in reversed(lines) if action in (None, x["action"])][:n]


def file_fingerprint(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            digest.update(block)
    return digest.hexdigest()[:16]


def table_fingerprint(df: DataFrame) -> str:
    """The same for the same rows in any order; sums of hashes, so it is one aggregate."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    s = df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).first()
    return hashlib.sha256(f"{df.columns}{s['n']}{s['s']}{s['x']}".encode()).hexdigest()[:16]


def operations() -> dict[str, Callable]:
    """What can be run in the background by name."""
    from tabguard.operators import anomaly, clean, entity, profile, recipe, reconcile, report, risk, validate

    return {
        "profile": profile.profile,
        "validate": validate.validate,
        "anomalies": anomaly.detect_anomalies,
        "reconcile": reconcile.reconcile,
        "clean": clean.apply_ops,
        "transform_apply": recipe.apply_recipe,
        "report": report.export_report,
        "fraud_train": risk.train,
        "fraud_score": risk.score,
        "reconcile_run": reconcile.run_profile,
        "kyc_match_names": entity.match_names,
        "kyc_dedupe": entity.dedupe_entities,
    }


class Jobs:
    """Actions run in the background, each in a job group of its own."""

    def __init__(self, spark: SparkSession, workers: int = 2):
        self.spark, self.pool, self.jobs = spark, ThreadPoolExecutor(workers), {}

    def submit(self, action: str, f: Callable[[], object]) -> str:
        key = uuid.uuid4().hex[:12]
        self.jobs[key] = {"id": key, "action": action, "state": "queued", "result": None, "error": None}

        def work():
            job = self.jobs[key]
            job["state"] = "running"
            self.spark.sparkContext.setJobGroup(key, action)
            try:
                job["result"], job["state"] = f(), "done"
            except Exception as e:
                job["error"], job["state"] = f"{type(e).__name__}: {e}", "error"

        self.jobs[key]["future"] = self.pool.submit(work)
        return key

    def run(self, operation: str, *args, **options) -> str:
        """Submits an operation by its name."""
        f = operations()[need(operation, operations(), "operation")]
        return self.submit(operation, lambda: f(*args, **options))

    def status(self, key: str) -> dict:
        job = self.jobs[need(key, self.jobs, "job")]
        return {k: v for k, v in job.items() if k != "future"}

    def wait(self, key: str, timeout: float | None = None) -> dict:
        self.jobs[need(key, self.jobs, "job")]["future"].result(timeout)
        return self.status(key)

    def list(self) -> list[dict]:
        return [self.status(k) for k in reversed(self.jobs)]
