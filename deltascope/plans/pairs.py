"""Pairs of package versions -> drift, score, findings, features, as one lazy plan."""
from pyspark.sql import DataFrame

from deltascope.operators import drift, facts, features, scoring
from deltascope.sources import manifests as manifest_source, packages


class PairAnalysis:
    """All results for a table of pairs; nothing runs until a result is used.

    `pairs` needs {pair_id, old_package_id, new_package_id}; `files` is the files table. Every result is
    a view over the same plan; write `summary` to a table first when several results are wanted. Pairs with
    a package that is absent, has no valid manifest, or was rejected (`verdicts` {package_id, rejected} of
    the archives) are in `failed` and nowhere else.
    """

    def __init__(self, pairs: DataFrame, files: DataFrame, manifests: DataFrame | None = None,
                 errors: DataFrame | None = None, verdicts: DataFrame | None = None, **patterns):
        if manifests is None:
            manifests = manifest_source.manifests_of(files)
        self.manifests = manifest_source.project_manifests(manifests)
        states = packages.package_states(files, self.manifests, verdicts)
        self.failed = drift.failed_pairs(pairs, states)
        self.pairs = drift.usable_pairs(pairs, states)
        self.facts = facts.fact_stream(files, self.manifests, **patterns)
        self.items = drift.items(self.pairs, self.facts, errors)
        self.summary = drift.summary(self.pairs, self.items, errors)

    @property
    def scores(self) -> DataFrame:
        return scoring.score(self.summary)

    @property
    def findings(self) -> DataFrame:
        return scoring.findings(self.scores)

    @property
    def features(self) -> DataFrame:
        return features.feature_table(self.pairs, self.summary)
