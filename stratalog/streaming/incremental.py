"""Incremental inference: each micro-batch of triples is the first delta of a semi-naive run.

For monotone rules alone (no NOT, SET or minted nodes): what was derived stays derived. An epoch's
triples and what follows from them are written to <path>/epoch=<n>, replacing an earlier try of the same
epoch, so a batch that Spark delivers again changes nothing.
"""
from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.errors import FixpointError, WellFormednessError
from stratalog.functions.exact import Context, FunctionRegistry
from stratalog.operators.materialize import materialize
from stratalog.plans.bodies import View
from stratalog.plans.fixpoint import Evaluator, Facts
from stratalog.plans.model import Negation, Pattern
from stratalog.sources.graph import standardized
from stratalog.sources.relations import KEYS, Relation, Source
from stratalog.terms import key


class IncrementalInference:
    def __init__(self, spark: SparkSession, rules, path: str, function_registry: FunctionRegistry | None = None, max_rounds: int = 1000):
        from stratalog.api import prepare_rules

        self.spark, self.path, self.max_rounds = spark, path.rstrip("/"), max_rounds
        self.prepared = prepare_rules(rules)
        for rule in self.prepared.rule_set.rules:
            if rule.run_once or rule.data_only or any(isinstance(e, Negation) for e in rule.body):
                raise WellFormednessError("incremental inference takes monotone rules: no NOT, SET, DATA bodies or minted nodes")
        self.context = Context(functions=dict(function_registry.functions) if function_registry else {})

    def triples(self, before: int | None = None) -> DataFrame:
        """All triples so far as keys (s, p, o)."""
        try:
            df = self.spark.read.schema(KEYS + ", epoch bigint").parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], KEYS)
        return (df if before is None else df.where(F.col("epoch") < before)).select("s", "p", "o")

    def start(self) -> None:
        """Epoch 0: the rules' own DATA."""
        rows = [tuple(map(key, t)) for t in standardized(self.prepared.rule_set.data, "data")]
        self.process(self.spark.createDataFrame(rows, KEYS), -1)

    def process(self, batch: DataFrame, epoch: int) -> None:
        """For foreachBatch. batch: keys (s, p, o)."""
        epoch += 1  # 0 is the rules' own data
        known = self.triples(before=epoch)
        new = materialize(batch.select("s", "p", "o").distinct().join(known, ["s", "p", "o"], "left_anti"))
        base = Source(self.spark)
        base.add_table(known)
        run = Evaluator(self.spark, self.prepared, base, self.context)
        delta = {None: [Relation(new, "key", "key")]}
        run.facts.add(None, delta[None][0])
        for _ in range(self.max_rounds):
            view = View(None, Facts(defaultdict(list, delta)).of)
            found = [x for i, rule in enumerate(run.rules) for k, e in enumerate(rule.body) if isinstance(e, Pattern) for x in run.derive(i, (k, view))]
            delta = run.keep(run.new(found), lazy=False) if found else {}
            if not delta:
                break
        else:
            raise FixpointError(f"still deriving after {self.max_rounds} rounds")
        run.everything().write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")

    def run(self, stream: DataFrame, checkpoint: str):
        """Start a query over a stream of keys (s, p, o)."""
        return stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
