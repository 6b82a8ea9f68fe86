"""A keyed table of small batches: deltas merged on read, so what a writer writes follows its batch.

A batch is written below the folder of its name and then committed by one small file that
numbers it; readers see committed batches only.  A name that is committed is not written
again, so a repeated job changes nothing, and a batch that was cut off is overwritten by its
repetition.  A batch either puts whole rows or updates some columns of rows that are there;
reading takes, key by key and column by column, the value of the last batch that set it.
``compact`` folds all committed batches into a base, after which reads start from there.

One writer at a time commits: a number that is taken raises, and the batch can be repeated.
Rows of one batch with the same key must be made one before (``sinks.keep_last``).  Files are
dealt by a hash of the key, so a batch has a few files whatever its order.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FILES = 8


class KeyedStore:
    """``schema`` is that of whole rows; ``keys`` name a row."""

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str]):
        self.spark, self.root, self.schema, self.keys = spark, root.rstrip("/"), schema, keys
        self.shape = StructType.fromDDL(schema)
        self.columns = [name for name in self.shape.names if name not in keys]

    def _empty(self) -> DataFrame:
        """No rows; a list made into a table would start Python workers in each job that unites with it."""
        return self.spark.range(0).select().to(self.shape)

    # ---- small files -------------------------------------------------------------------

    def _path(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _create(self, name: str, value: dict) -> None:
        """Fails if the file is there."""
        p, fs = self._path(name)
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def _all(self, folder: str) -> list[dict]:
        p, fs = self._path(folder)
        if not fs.exists(p) or not (names := [x.getPath().toString() for x in fs.listStatus(p)]):
            return []
        return [json.loads(r["value"]) for r in self.spark.read.text(names, wholetext=True).collect()]

    def commits(self) -> list[dict]:
        """Committed batches in order; one small record each."""
        return sorted(self._all("commits"), key=lambda c: c["n"])

    def _base(self) -> dict | None:
        return max(self._all("bases"), key=lambda b: b["upto"], default=None)

    # ---- writing -----------------------------------------------------------------------

    def put(self, rows: DataFrame, batch: str) -> bool:
        """Inserts or replaces whole rows; columns that are missing become null.  False if the batch is there already."""
        return self._write(rows, batch, self.columns, True, False)

    def update(self, rows: DataFrame, batch: str, coalesce: bool = False) -> bool:
        """Sets the columns given, of rows that are there; with ``coalesce`` a null value sets nothing."""
        return self._write(rows, batch, [c for c in rows.columns if c not in self.keys], False, coalesce)

    def _write(self, rows: DataFrame, batch: str, columns: list[str], whole: bool, coalesce: bool) -> bool:
        if unknown := set(rows.columns) - {*self.keys, *self.columns}:
            raise ValueError(f"unknown columns {sorted(unknown)}")
        done = self.commits()
        if any(c["batch"] == batch for c in done):
            return False
        folder = f"deltas/{hashlib.sha256(batch.encode()).hexdigest()[:32]}"
        shaped = self._empty().unionByName(rows.select(*[c for c in rows.columns if c in self.keys + columns]), allowMissingColumns=True)
        shaped.repartition(FILES, *self.keys).write.mode("overwrite").parquet(f"{self.root}/{folder}")
        n = 1 + max([c["n"] for c in done] + [(self._base() or {"upto": 0})["upto"]])
        self._create(f"commits/{n:012d}.json", {"n": n, "batch": batch, "folder": folder, "columns": columns, "whole": whole, "coalesce": coalesce})
        return True

    # ---- reading -----------------------------------------------------------------------

    def read(self) -> DataFrame:
        """The rows as all committed batches leave them: one aggregation by key, with partial sums map-side."""
        base = self._base()
        commits = [c for c in self.commits() if not base or c["n"] > base["upto"]]
        parts = [(base["folder"], {"n": base["upto"], "columns": self.columns, "whole": True, "coalesce": False})] if base else []
        parts += [(c["folder"], c) for c in commits]
        if not parts:
            return self._empty()
        rows = None
        for folder, c in parts:
            sets = lambda name, c=c: F.lit(False) if name not in c["columns"] else F.col(name).isNotNull() if c["coalesce"] else F.lit(True)
            n = F.lit(c["n"]).cast("long")
            # each value with the number of its batch where it sets the column
            one = self.spark.read.schema(self.schema).parquet(f"{self.root}/{folder}").select(
                *self.keys, F.lit(c["whole"]).alias("__whole"), *[F.when(sets(x), F.struct(n.alias("n"), F.col(x).alias("v"))).alias(x) for x in self.columns]
            )
            rows = one if rows is None else rows.unionByName(one)
        last = lambda x: F.max_by(F.col(x)["v"], F.col(x)["n"]).alias(x)
        merged = rows.groupBy(*self.keys).agg(F.max("__whole").alias("__whole"), *[last(x) for x in self.columns]).filter("__whole")
        return merged.select(*self.shape.names)

    def compact(self) -> None:
        """Folds what is committed into a base; batches committed meanwhile stay deltas."""
        upto = max([c["n"] for c in self.commits()], default=0)
        if not upto or upto == (self._base() or {"upto": 0})["upto"]:
            return
        folder = f"data/{uuid.uuid4().hex}"
        self.read().write.parquet(f"{self.root}/{folder}")
        self._create(f"bases/{upto:012d}.json", {"upto": upto, "folder": folder})


#: Columns of the stored statistics, of the artefact registry and of the decision ledger.
STATS = "stats_id string, feature_set string, schema_version int, split_id string, train_start date, train_end date, holdout_start date, purge_bars int, max_label_horizon_bars int, feature_name string, mean double, std double, n long, n_missing long"
ARTEFACTS = "pca_artifact_id string, fusion_version string, stats_id string, fit_start date, fit_end date, n_fit_rows long, n_components int, explained_variance_ratio_sum double, model_repo string, artifact_path string, artifact_hash string"
#: Columns of a decision that hold JSON, with the text of an absent one.
JSON_COLUMNS = {
    "reason_codes": "null", "thesis_update": "null", "risk_flags": "null", "portfolio_state": "null", "execution_result": "null", "iron_blocks": "[]", "iron_penalties": "[]",
    "iron_entry_blocks_at_decision": "[]", "toxic_breaker_factors_at_decision": "[]", "objective_tension_types_at_decision": "[]",
}
#: The 35 columns of a decision in order, and those that are empty texts by default.
DECISION = [
    "id long", "run_id string", "symbol string", "date date", "day_index long", "close_price double", "action string", "target_position_pct double", "confidence double", "reason_codes string",
    "thesis_update string", "risk_flags string", "brief_rationale string", "inner_journal string", "portfolio_state string", "execution_result string", "iron_verdict string", "iron_blocks string",
    "iron_penalties string", "snapshot_source string", "snapshot_schema_version string", "v8_grade_at_decision string", "v8_score_at_decision double", "iron_entry_verdict_at_decision string",
    "iron_entry_blocks_at_decision string", "toxic_breaker_factors_at_decision string", "objective_tension_types_at_decision string", "policy_gate_reason string", "pattern_recall_version string",
    "embedding_arm string", "stats_id string", "pca_artifact_id string", "top_k_case_ids string", "evidence_card_json string", "fund_manager_interpretation string",
]
EMPTY = {"inner_journal", "iron_verdict", "snapshot_source", "snapshot_schema_version", "v8_grade_at_decision", "iron_entry_verdict_at_decision", "policy_gate_reason", "pattern_recall_version", "embedding_arm", "stats_id", "pca_artifact_id", "top_k_case_ids", "evidence_card_json", "fund_manager_interpretation"}


def stats_store(spark: SparkSession, root: str) -> KeyedStore:
    return KeyedStore(spark, root, STATS, ["stats_id", "feature_name"])


def stats_rows(stats: DataFrame, names: list[str], stats_id: str, split_id: str, train_start, train_end, holdout_start, purge: int = 20, horizon: int = 20) -> DataFrame:
    """Statistics (dim, mean, std, n, n_missing) as rows of STATS; ``names`` name the dimensions."""
    name = F.array(*[F.lit(x) for x in names])[F.col("dim")]
    fixed = {"stats_id": stats_id, "feature_set": "warpcore_v1", "schema_version": 1, "split_id": split_id, "purge_bars": purge, "max_label_horizon_bars": horizon}
    days = {"train_start": train_start, "train_end": train_end, "holdout_start": holdout_start}
    return stats.select(*[F.lit(v).alias(k) for k, v in fixed.items()], *[F.lit(v).cast("date").alias(k) for k, v in days.items()], name.alias("feature_name"), "mean", "std", "n", "n_missing")


def ledger_store(spark: SparkSession, root: str) -> KeyedStore:
    return KeyedStore(spark, root, ", ".join(DECISION), ["id"])


def as_json(value: Column, absent: str) -> Column:
    return F.coalesce(F.to_json(value, {"ignoreNullFields": "false"}), F.lit(absent))


def decision_rows(df: DataFrame, existing: DataFrame) -> DataFrame:
    """Decisions as rows of the ledger, numbered on from its largest id by (day_index, run_id, date).

    Columns that JSON holds may be arrays, maps or structs; absent lists are [], absent texts empty.
    """
    from ..operators import stats

    found, out = {f.name: f.dataType.typeName() for f in df.schema}, []
    for column in DECISION[1:]:
        name, kind = column.split()
        if name in JSON_COLUMNS:
            out.append((as_json(F.col(name), JSON_COLUMNS[name]) if found.get(name) in ("array", "map", "struct") else F.coalesce(F.col(name), F.lit(JSON_COLUMNS[name])) if name in found else F.lit(JSON_COLUMNS[name])).alias(name))
        elif name in found:
            value = F.col(name).cast(kind)
            out.append((F.coalesce(value, F.lit("")) if name in EMPTY else value).alias(name))
        else:
            out.append(F.lit("" if name in EMPTY else None).cast(kind).alias(name))
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    rows = df.select(*out).withColumn("__order", F.struct("run_id", "date", "day_index"))
    ranked = stats.ordinal(rows, "day_index", "__order", "__id")
    return ranked.select((F.lit(top) + F.col("__id")).cast("long").alias("id"), *[c.split()[0] for c in DECISION[1:]])


class Artefacts:
    """Fitted bases as JSON files with a registry of their hashes and of what they were fitted on."""

    VERSION = "fused_concat_v1"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.registry = KeyedStore(spark, f"{self.root}/registry", ARTEFACTS, ["pca_artifact_id"])

    def save(self, basis: dict, artefact_id: str, fit_start, fit_end, stats_id: str | None = None, model_repo: str | None = None) -> dict:
        """Writes the basis and its record; the same basis under the same id changes nothing, another one raises."""
        from ..operators import fusion

        text, digest = fusion.save(basis)
        known = self.record(artefact_id)
        if known:
            if known["artifact_hash"] != digest:
                raise ValueError(f"{artefact_id} holds another basis")
            return known
        path = f"{self.root}/{artefact_id}-{digest[:16]}.json"
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
        share = round(float(basis["explained"]), 6)
        row = (artefact_id, self.VERSION, stats_id, str(fit_start), str(fit_end), basis["n"], len(basis["components"]), share, model_repo, path, digest)
        names = [c.split()[0] for c in ARTEFACTS.split(", ")]
        df = self.spark.createDataFrame([row], ", ".join(f"{n} {'string' if n.startswith('fit_') else k}" for n, k in (c.split() for c in ARTEFACTS.split(", "))))
        self.registry.put(df.withColumns({n: F.col(n).cast("date") for n in ("fit_start", "fit_end")}).select(*names), f"{artefact_id}-{digest}")
        return self.record(artefact_id)

    def record(self, artefact_id: str) -> dict | None:
        row = self.registry.read().filter(F.col("pca_artifact_id") == artefact_id).first()
        return row.asDict() if row else None

    def load(self, artefact_id: str, as_of=None) -> dict:
        """The basis; raises if it is unknown, was changed, or was fitted on days after ``as_of``."""
        known = self.record(artefact_id)
        if known is None:
            raise KeyError(artefact_id)
        text = self.spark.read.text(known["artifact_path"], wholetext=True).first()["value"].rstrip("\n")
        if hashlib.sha256(text.encode()).hexdigest() != known["artifact_hash"]:
            raise ValueError(f"{artefact_id} is not what its record says")
        if as_of is not None and str(known["fit_end"]) > str(as_of):
            raise ValueError(f"{artefact_id} was fitted up to {known['fit_end']}, after {as_of}")
        return json.loads(text)
