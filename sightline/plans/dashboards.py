"""The five dashboards: every panel is a lazy table over the same sightings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators import alerts, clusters, spatial, temporal, threat
from sightline.operators.predicates import is_invasive_named


def dashboards(s: DataFrame, as_of: Column) -> dict[str, dict[str, DataFrame]]:
    """Panels by dashboard. Pass a filtered or cached table to share one scan between them."""
    named = s.where(is_invasive_named(F.col("predicted_species")))
    daily = threat.invasive_daily(s, as_of)
    return {
        "species": {"stats": threat.species_stats(s)},
        "invasive": {
            "overview": threat.pair_overview(s), "risk": threat.invasive_risk(s), "hotspots": spatial.hotspots(named),
            "spread": spatial.spread_patterns(named), "breakdown": threat.risk_breakdown(s), "unknown": threat.unknown_summary(s),
        },
        "geographic": {
            "clusters": clusters.leader_clusters(s), "density": spatial.density_summary(s), "coverage": spatial.coverage_stats(s),
            "distances": spatial.distance_histogram(s), "counts": spatial.species_count_top(s), "ranges": spatial.species_range_top(s),
        },
        "temporal": {
            "patterns": temporal.time_patterns(s), "trends": temporal.trends(s, as_of), "seasons": temporal.seasonal_patterns(s),
            "daily": daily, "impact": threat.environmental_impact(daily), "weekly": temporal.timeline_weekly(s),
            "monthly": temporal.timeline_monthly(s), "yearly": temporal.timeline_yearly(s),
        },
        "risk": {
            "alerts": alerts.risk_alerts(s, as_of), "priorities": alerts.priorities(s), "recommendations": alerts.recommendations(s),
        },
    }
