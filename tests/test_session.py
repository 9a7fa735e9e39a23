"""Session rules: the configured checkpoint folder wins; broadcast only measured sides."""

from __future__ import annotations

from grovecount.session import ensure_checkpoint_dir


def test_checkpoint_dir_is_the_configured_one(spark):
    path = ensure_checkpoint_dir(spark)
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        # Spark keeps checkpoints in a per-application subfolder of the configured one
        assert configured.rstrip("/").split(":")[-1] in path
    assert ensure_checkpoint_dir(spark) == path  # stable, never replaced


def test_broadcast_only_measured_sides(spark):
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    assert int(spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold")) > 0
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_stored_rounds_guard_only_in_estimate_sessions(spark):
    from grovecount.plans.lineage import RoundTables

    def hinted(df) -> bool:
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString() or \
            "merge" in df._jdf.queryExecution().logical().toString().lower()

    rounds = RoundTables(spark, "t")
    assert not hinted(rounds.write(spark.range(5), "a"))        # measured-only policy: no hint
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
        stored = rounds.write(spark.range(5), "b")
        assert hinted(stored)
        joined = stored.join(spark.range(3), "id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and joined.count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
