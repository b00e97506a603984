"""Silver and gold tables of a claim star, each a lazy plan."""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from claimloom.operators import clean, features, risk
from claimloom.sources.scratch import written
from claimloom.sources.star import CLAIM_COLUMNS, ClaimStar

AS_OF = datetime.date(2001, 10, 1)
COPY_ORDER = ["row_key"]


@dataclass(frozen=True)
class Medallion:
    star: ClaimStar

    @cached_property
    def providers(self) -> DataFrame:
        return clean.silver_providers(self.star.providers)

    @cached_property
    def diagnosis(self) -> DataFrame:
        return clean.silver_diagnosis(self.star.diagnosis)

    @cached_property
    def cost(self) -> DataFrame:
        return written(clean.silver_cost(self.star.cost), "silver_cost")

    @cached_property
    def standard(self) -> DataFrame:
        """Deduplicated claims, written once: the medians and the rows then scan a table
        instead of repeating the deduplication shuffle."""
        columns = [c for c in self.star.claims.columns if c in CLAIM_COLUMNS]
        return written(clean.standard_claims(self.star.claims, COPY_ORDER).select(*columns), "standard_claims")

    @cached_property
    def claims(self) -> DataFrame:
        return clean.silver_claims(self.standard, self.providers)

    @cached_property
    def scored(self) -> DataFrame:
        return risk.score_claims(self.claims, self.cost)

    @cached_property
    def labeled(self) -> DataFrame:
        """The labeled table is a layer boundary: written once, read by every later branch."""
        return written(risk.labeled_claims(self.scored), "labeled_claims")

    @cached_property
    def base(self) -> DataFrame:
        return features.claim_base(self.labeled, self.providers, self.diagnosis, self.cost)

    @cached_property
    def feature_table(self) -> DataFrame:
        return features.feature_table(self.labeled, self.providers, self.diagnosis, self.cost)

    @cached_property
    def gold(self) -> DataFrame:
        return features.gold_features(self.feature_table)

    @cached_property
    def wide_rules(self) -> DataFrame:
        s = self.star
        return risk.wide_claims(s.claims, s.providers, s.diagnosis, s.cost, COPY_ORDER, AS_OF)
