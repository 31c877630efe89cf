"""Queries on proportional hazards; tests hold the fits against plain versions, as SQL cannot iterate them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import survival as V
from .registry import register
from .views import runs

_SCHEMA = "covariate string, coef double, hr double, se double, z double, n_events int, converged boolean, hr_lo double, hr_hi double, p double, separated boolean"


def _design(spark, sf_dir):
    r = runs(spark, sf_dir)
    r, configs = V.dummies(r, "config", 0)
    r, models = V.dummies(r, "model", 0)
    return r, [*configs, *models]


def _fit(spark, sf_dir, **how):
    r, names = _design(spark, sf_dir)
    return V.fit_cox(r, names, "duration", "hit", **how)


def _rows(spark, fit):
    rows = fit.rows() if fit else []
    out = spark.createDataFrame([tuple(r[f.split()[0]] for f in _SCHEMA.split(", ")) for r in rows], _SCHEMA)
    return out.withColumns({c: F.round(c, 6) for c, t in out.dtypes if t == "double"})


@register()
def hazard_ratios_by_model(spark, sf_dir):
    """Hazard ratios of configurations and models against the first of each, errors by scenario, with limits, p values and a flag for separation."""
    return _rows(spark, _fit(spark, sf_dir, cluster="scenario"))


@register()
def hazard_ratios_stratified(spark, sf_dir):
    """The same with a baseline hazard for each scenario."""
    return _rows(spark, _fit(spark, sf_dir, strata=["scenario"]))


@register()
def proportionality(spark, sf_dir):
    """Scaled Schoenfeld residuals of the clustered fit against event ranks, Holm over the covariates."""
    fit = _fit(spark, sf_dir, cluster="scenario")
    out = V.ph_test(fit) if fit else spark.createDataFrame([], "covariate string, chi2 double, p double, p_holm double")
    return out.withColumns({c: F.round(c, 6) for c in ("chi2", "p", "p_holm")})
