"""Events and evidence: page logs, merging, tenure, series gates, lineage and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import interval_join
from tidemark.session import settle


def page_completeness(pages: DataFrame) -> DataFrame:
    """Queries whose pages are not 1..page_count once each with constant counts and all rows present."""
    per = pages.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_distinct("page").alias("_d"), F.min("page").alias("_a"), F.max("page").alias("_b"),
        F.min("page_count").alias("_c0"), F.max("page_count").alias("_c1"), F.min("total").alias("_t0"), F.max("total").alias("_t1"), F.sum("rows").alias("_rows"),
    )
    rules = {
        "page_count_changes": F.col("_c0") != F.col("_c1"), "total_changes": F.col("_t0") != F.col("_t1"), "duplicate_page": F.col("_n") != F.col("_d"),
        "missing_page": (F.col("_a") != 1) | (F.col("_b") != F.col("_c1")) | (F.col("_d") != F.col("_c1")), "row_total": F.col("_rows") != F.col("_t1"),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return per.select("query_id", found.alias("violations")).where(F.size("violations") > 0)


def folded(title: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(title, r"\s+", " ")))


def event_merge(events: DataFrame, keys: Sequence[str], provenance: Sequence[str]) -> DataFrame:
    """One event per canonical key; provenance entries without repeats. Entries are made distinct before they
    are gathered, so an event reported many times by few sources stays small."""
    key = {"title": folded(F.col("title"))}
    entries = events.withColumns(key).select(*keys, *provenance).distinct()
    return entries.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*provenance))).alias("provenance"))


# The time zone of every venue.
VENUE_ZONES = {"SH": "Asia/Shanghai", "SZ": "Asia/Shanghai", "HK": "Asia/Hong_Kong"}


def exchange_date(instant: Column, venue: Column) -> Column:
    """The date of an instant on the clock of its venue; null for an unknown venue or instant.

    A notice of the evening before in UTC is one of the next day on the exchange: `event_window_filter` takes these dates.
    """
    utc = F.to_utc_timestamp(instant, F.current_timezone())
    zone = F.element_at(F.create_map(*[F.lit(x) for pair in VENUE_ZONES.items() for x in pair]), venue)
    return F.to_date(F.from_utc_timestamp(utc, zone))


def event_window_filter(events: DataFrame, start: date, asof: date) -> DataFrame:
    """Events with no known date after `asof`, that happened and were published in the window unless the case is
    still open. An unknown date rules nothing out."""
    at, begin = F.lit(asof), F.lit(start)

    def holds(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(True))

    known = holds(F.col("occurrence_date") <= at) & holds(F.col("publication_date") <= at) & holds(F.col("effective_date") <= at)
    inside = holds(F.col("occurrence_date") >= begin) & holds(F.col("publication_date") >= begin)
    return events.where(known & (inside | F.coalesce(F.col("status") == "open", F.lit(False))))


def event_rules(events: DataFrame, rules: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Events whose combination of values is in no row of the rule table."""
    return events.join(rules.select(*columns).distinct(), list(columns), "left_anti")


def tenure_match(events: DataFrame, roster: DataFrame) -> DataFrame:
    """Roster segment of each event's subject and role: matched, unknown person, no segment, several segments."""
    segments = roster.select("person_id", "role", "tenure_start", "tenure_end", "segment_id")
    probe = events.withColumnRenamed("subject_id", "person_id")
    hits = interval_join(probe, segments, ["person_id", "role"], "occurrence_date", "tenure_start", "tenure_end", closed_end=True)
    who = ["record_id", "person_id", "role"]
    counted = hits.groupBy(*who).agg(F.count(F.lit(1)).alias("_n"), F.min("segment_id").alias("_segment"))
    people = roster.select("person_id").distinct().withColumn("_known", F.lit(True))
    out = probe.join(counted, who, "left").join(people, "person_id", "left")
    state = F.when(F.col("_known").isNull(), "unknown_person").when(F.col("_n").isNull(), "no_segment").when(F.col("_n") > 1, "ambiguous").otherwise("matched")
    return out.select("record_id", "person_id", state.alias("match"), F.when(state == "matched", F.col("_segment")).alias("segment_id"))


def active_listings(listings: DataFrame, asof: Column) -> DataFrame:
    state = F.when(F.col("listed_from") > asof, "future").when(F.col("listed_to").isNotNull() & (F.col("listed_to") <= asof), "historical").otherwise("active")
    return listings.withColumn("listing_state", state)


def required_sources(subjects: DataFrame, required: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    """(subject, source) a rule asks for and no record has."""
    return subjects.join(required, list(on)).join(present, ["subject_id", "source_id"], "left_anti")


def roster_coverage(coverage: DataFrame, listings: DataFrame, roles: Sequence[str]) -> DataFrame:
    """Whether roster coverage contains the listing history, and the roles it lacks."""
    held = coverage.groupBy("issuer").agg(F.min("start").alias("_a"), F.max("end").alias("_b"), F.collect_set("role").alias("_roles"))
    out = listings.join(held, "issuer", "left")
    covered = F.coalesce((F.col("_a") <= F.col("listed_from")) & (F.col("_b") >= F.col("listed_to")), F.lit(False))
    lacking = F.array_except(F.array(*[F.lit(r) for r in roles]), F.coalesce(F.col("_roles"), F.array().cast("array<string>")))
    return out.select("issuer", covered.alias("covered"), F.array_sort(lacking).alias("missing_roles"))


def observation_freshness(observations: DataFrame, latest: DataFrame, keys: Sequence[str], asof: Column, max_age: int) -> DataFrame:
    """First failing rule of each observation: future, not the latest one, too old; NULL when fresh."""
    newest = latest.groupBy(*keys).agg(F.max("date").alias("_latest"))
    out = observations.join(newest, list(keys), "left")
    d = F.col("date")
    rule = F.when(d > asof, "future").when(d != F.col("_latest"), "not_latest").when(F.datediff(asof, d) > max_age, "stale")
    return out.withColumn("failure", rule).drop("_latest")


# --- series -----------------------------------------------------------------------------------


def scope_fingerprint(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Hash of the trimmed, lower-cased scope dimensions in name order."""
    parts = [F.lower(F.trim(F.col(c).cast("string"))).alias(c) for c in sorted(dims)]
    return df.withColumn("scope_fingerprint", F.sha2(F.to_json(F.struct(*parts)), 256))


def period_frequency(period: Column) -> Column:
    """A, Q or M of `1995`, `1995Q2` (or `1995-Q2`) and `1995-06`; null for anything else."""
    p = period.cast("string")
    return F.when(p.rlike("^[0-9]{4}$"), "A").when(p.rlike("^[0-9]{4}-?Q[1-4]$"), "Q").when(p.rlike("^[0-9]{4}-(0[1-9]|1[0-2])$"), "M")


def period_number(period: Column) -> Column:
    """Years, quarters or months since year 0, by the period's own frequency; null for anything else."""
    p = period.cast("string")
    year, last = F.substring(p, 1, 4).cast("int"), F.regexp_extract(p, "([0-9]{1,2})$", 1).cast("int")
    freq = period_frequency(period)
    return F.when(freq == "A", year).when(freq == "Q", year * 4 + F.right(p, F.lit(1)).cast("int") - 1).when(freq == "M", year * 12 + last - 1)


def period_label(frequency: Column, number: Column) -> Column:
    year = lambda per: F.lpad(F.floor(number / per).cast("string"), 4, "0")
    part = lambda per: (number % per + 1).cast("string")
    return F.when(frequency == "A", year(1)).when(frequency == "Q", F.concat(year(4), F.lit("Q"), part(4))).when(frequency == "M", F.concat(year(12), F.lit("-"), F.lpad(part(12), 2, "0")))


def series_continuity(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Periods missing between the first and last period of each series: spine minus data.

    Periods are years as numbers, or labels of years, quarters or months; a series of labels is spanned in its own frequency.
    Series that mix frequencies, or state periods of no known form, are for `series_frequency`; here each frequency has its own span.
    """
    if series.schema["period"].dataType.simpleString() != "string":
        spans = series.groupBy(*keys).agg(F.min("period").alias("_a"), F.max("period").alias("_b"))
        spine = spans.select(*keys, F.explode(F.sequence("_a", "_b")).alias("period"))
        return spine.join(series.select(*keys, "period"), [*keys, "period"], "left_anti")
    numbered = series.select(*keys, period_frequency(F.col("period")).alias("_f"), period_number(F.col("period")).alias("_n")).where(F.col("_n").isNotNull())
    spans = numbered.groupBy(*keys, "_f").agg(F.min("_n").alias("_a"), F.max("_n").alias("_b"))
    spine = spans.select(*keys, "_f", F.explode(F.sequence("_a", "_b")).alias("_n")).join(numbered, [*keys, "_f", "_n"], "left_anti")
    return spine.select(*keys, period_label(F.col("_f"), F.col("_n")).alias("period"))


def series_frequency(series: DataFrame, keys: Sequence[str], wanted: str | None = None) -> DataFrame:
    """Each series' frequency, and why it fails: `mixed`, `unknown` periods, or another one than is `wanted`."""
    freq = period_frequency(F.col("period"))
    per = series.groupBy(*keys).agg(F.min(freq).alias("frequency"), F.count_distinct(freq).alias("_kinds"), F.max(freq.isNull()).alias("_odd"))
    other = F.col("frequency") != wanted if wanted else F.lit(False)
    failure = F.when(F.col("_odd"), "unknown").when(F.col("_kinds") > 1, "mixed").when(other, "frequency")
    return per.select(*keys, F.when(failure.isNull() | (failure == "frequency"), F.col("frequency")).alias("frequency"), failure.alias("failure"))


def series_freshness(series: DataFrame, keys: Sequence[str], last_completed: int, lag: int) -> DataFrame:
    """Series whose newest period is older than the last completed one minus the allowed lag."""
    newest = series.groupBy(*keys).agg(F.max("period").alias("latest_period"))
    return newest.withColumn("fresh", F.col("latest_period") >= last_completed - lag)


def vintage_freshness(series: DataFrame, keys: Sequence[str], asof: Column, max_age: int) -> DataFrame:
    """Freshness by when the data was made, not by what it is about or when it was printed again.

    `vintage` is the date of the data, `published_at` that of its print. A series is fresh if its newest vintage is at most
    `max_age` days before `asof`; one dated after its own publication, or after `asof`, is not evidence at all.
    """
    per = series.groupBy(*keys).agg(F.max("vintage").alias("vintage"), F.max(F.col("vintage") > F.col("published_at")).alias("_early"))
    rule = F.when(F.col("vintage").isNull(), "undated").when(F.col("_early") | (F.col("vintage") > asof), "future").when(F.datediff(asof, F.col("vintage")) > max_age, "stale")
    return per.select(*keys, "vintage", rule.alias("failure"))


def in_canonical_units(series: DataFrame, units: DataFrame) -> DataFrame:
    """`value` in the unit's canonical one: `units` has (unit, canonical_unit, factor). An unknown unit leaves both null."""
    known = series.drop("canonical_unit").join(units.select("unit", "canonical_unit", F.col("factor").alias("_factor")), "unit", "left")
    return known.withColumn("value", F.col("value") * F.col("_factor")).drop("_factor")


def meeting_groups(members: DataFrame, key: str, node: str, via: str) -> DataFrame:
    """`key, node, root`: nodes of a key that meet at a common `via` are one group, named by its smallest node.

    Rounds of the smallest root over what a node meets, each followed by a jump to the root's own root, until none changes. A
    round is two partial aggregates over the memberships, so a `via` that very many nodes share meets no single task.
    """
    held = settle(members.select(key, node, via).distinct())
    roots = settle(held.select(key, node, F.col(node).alias("root")).distinct())
    while True:
        met = held.join(roots, [key, node]).groupBy(key, via).agg(F.min("root").alias("root"))
        near = held.join(met, [key, via]).groupBy(key, node).agg(F.min("root").alias("_near"))
        jump = near.select(key, F.col(node).alias("_near"), F.col("_near").alias("_far"))
        moved = near.join(jump, [key, "_near"]).join(roots, [key, node])
        moved = settle(moved.select(key, node, F.least("_far", "root").alias("root"), (F.least("_far", "root") < F.col("root")).alias("_moved")))
        roots = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return roots


def series_stitch(series: DataFrame, key: str = "claim_id", units: DataFrame | None = None) -> DataFrame:
    """One series of a claim from its sources: `key, period, value, source_id, series_form`.

    Sources join only where they meet: sources that share a period are linked, and all of a claim must hang together in one group
    of links, so two pairs that meet only among themselves are no series. Where they meet their values must agree, in canonical units if
    `units` is given; a value in an unknown unit rejects its claim. Each period keeps its first source; the form is `single` or `stitched`.
    Values are compared as rounded to nine digits after the point, so that a unit's factor does not set equal ones apart.
    """
    if units is not None:
        series = in_canonical_units(series, units)
    stated = series.withColumn("_v", F.round("value", 9))
    per = stated.groupBy(key, "period").agg(
        F.count_distinct("_v").alias("_values"), F.min_by("value", "source_id").alias("value"), F.min("source_id").alias("source_id"), F.max(F.col("_v").isNull()).alias("_unknown")
    )
    clash = per.where((F.col("_values") > 1) | F.col("_unknown")).select(key)
    groups = meeting_groups(series, key, "source_id", "period").groupBy(key).agg(F.count_distinct("root").alias("_groups"), F.count(F.lit(1)).alias("_sources"))
    whole = groups.where(F.col("_groups") == 1).select(key, F.when(F.col("_sources") > 1, "stitched").otherwise("single").alias("series_form"))
    return per.join(clash.distinct(), key, "left_anti").join(whole, key).select(key, "period", "value", "source_id", "series_form")


def series_conflict(series: DataFrame, strength: DataFrame, key: str = "claim_id") -> DataFrame:
    """Periods where sources of no less standing state different values.

    A source counts when no other source of that period is at least as good in both ratings and better in
    one. Ratings of a period are made distinct and walked from the best authority down: a rating is beaten
    when one before it has no lower directness. `strength` has (source_id, authority, directness).
    """
    rated = series.join(strength, "source_id")
    ratings = rated.select(key, "period", "authority", "directness").distinct()
    w = Window.partitionBy(key, "period").orderBy(F.desc("authority"), F.desc("directness")).rowsBetween(Window.unboundedPreceding, -1)
    beaten = F.coalesce(F.max("directness").over(w) >= F.col("directness"), F.lit(False))
    counting = ratings.withColumn("_beaten", beaten).where(~F.col("_beaten")).drop("_beaten")
    left = rated.join(counting, [key, "period", "authority", "directness"], "left_semi")
    return left.groupBy(key, "period").agg(F.count_distinct("value").alias("n_values")).where(F.col("n_values") > 1)


def lineage_id(df: DataFrame) -> DataFrame:
    """Shared id of what a document draws on: provider table, else report, else dataset, else itself."""
    norm = lambda c: F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))
    tagged = [F.when(norm(c).isNotNull(), F.concat(F.lit(f"{tag}:"), norm(c))) for tag, c in (("table", "provider_table"), ("report", "report"), ("dataset", "dataset"), ("document", "document_id"))]
    return df.withColumn("lineage_id", F.coalesce(*tagged))


def independent_sources(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return lineage_id(df).groupBy(*keys).agg(F.count_distinct("lineage_id").alias("n_independent"))


# The gates in the order they are reported.
GATES = ("identity", "scope", "continuity", "status", "freshness", "authority", "support", "lineage", "conflict")


def gate_failures(df: DataFrame, failed: dict[str, Column]) -> DataFrame:
    """Ordered list of the gates a claim fails; a gate that is not one of GATES is an error."""
    if unknown := set(failed) - set(GATES):
        raise ValueError(f"unknown gates: {sorted(unknown)}")
    named = [F.when(F.coalesce(failed[g], F.lit(False)), F.lit(g)) for g in GATES if g in failed]
    return df.withColumn("failures", F.array_compact(F.array(*named)))


def role_rollup(roles: DataFrame, key: str) -> DataFrame:
    """State of a bundle from the states of its required roles.

    `roles` may have required_periods and accepted_periods, for `missing_periods` of (role, period), and claim_id, for
    `unresolved_claim_ids`: those of roles that are neither complete nor not applicable.
    """
    state, required = F.col("state"), F.col("required")
    more = []
    if {"required_periods", "accepted_periods"} <= set(roles.columns):
        none = F.array().cast(roles.schema["required_periods"].dataType)
        gaps = F.array_except(F.coalesce("required_periods", none), F.coalesce("accepted_periods", none))
        gaps = F.transform(gaps, lambda p: F.struct(F.col("role").alias("role"), p.alias("period")))
        more.append(F.array_sort(F.array_distinct(F.flatten(F.collect_list(gaps)))).alias("missing_periods"))
    if "claim_id" in roles.columns:
        settled = F.coalesce(state.isin("complete", "not-applicable"), F.lit(False))
        more.append(F.array_sort(F.collect_set(F.when(~settled, F.col("claim_id")))).alias("unresolved_claim_ids"))
    per = roles.groupBy(key).agg(
        F.bool_or(required & (state == "blocked")).alias("_blocked"), F.bool_and(state == "complete").alias("_all"),
        F.array_sort(F.collect_set(F.when(state != "complete", F.col("role")))).alias("open_roles"), *more,
    )
    out = F.when(F.col("_blocked"), "blocked").when(F.col("_all"), "complete").otherwise("publishable-with-gaps")
    return per.select(key, out.alias("bundle_state"), *per.columns[3:])


def route_select(routes: DataFrame, requests: DataFrame, now: Column, fresh_days: int = 7, fallbacks: DataFrame | None = None) -> DataFrame:
    """Routes of each request in order: matching function, geography (or global) and industry, by authority;
    a route found unreachable lately goes last with a skip reason, an old finding is ignored.

    `requests` has (request_id, function, geography, industry). A request asks under its own and the global
    geography and under its own and any industry, so the match is an equi-join on all three. `fallbacks` has
    (route_id, fallback_id): they are followed from the routes of a request, whatever their function but in its
    geography and industry, each once for a request, and come after the routes that match by themselves.
    """
    asked = requests.withColumn("geography", F.explode(F.array_distinct(F.array("geography", F.lit("global")))))
    asked = asked.withColumn("industry", F.explode(F.array_distinct(F.array("industry", F.lit("*")))))
    routes = routes.withColumn("industry", F.coalesce("industry", F.lit("*")))
    met = routes.join(asked, ["function", "geography", "industry"]).withColumn("_layer", F.lit(0))
    if fallbacks is not None:
        followed = _follow(met.select("request_id", "route_id"), fallbacks, asked.select("request_id", "geography", "industry"), routes)
        later = routes.join(followed, "route_id").withColumn("_layer", F.lit(1))
        met = met.select(*later.columns).unionByName(later)
    skip = (F.col("last_status") == "unreachable") & (F.datediff(now, "checked") <= fresh_days)
    w = Window.partitionBy("request_id").orderBy(F.coalesce(skip, F.lit(False)).cast("int"), "_layer", F.desc("authority"), "route_id")
    return met.select(
        "request_id", "route_id", F.row_number().over(w).alias("place"), F.when(skip, F.lit("recently_unreachable")).alias("skip_reason")
    )


def _follow(matched: DataFrame, fallbacks: DataFrame, asked: DataFrame, routes: DataFrame) -> DataFrame:
    """(request_id, route_id) that fallbacks lead to from `matched` and that are not among them, a round for each step of the
    longest chain; a route met before is not followed again."""
    keys = ["request_id", "route_id"]
    step = fallbacks.join(routes.select(F.col("route_id").alias("fallback_id"), "geography", "industry"), "fallback_id")
    first = seen = front = settle(matched.distinct())
    while not front.isEmpty():
        reached = front.join(step, "route_id").join(asked, ["request_id", "geography", "industry"], "left_semi")
        front = settle(reached.select("request_id", F.col("fallback_id").alias("route_id")).distinct().join(seen, keys, "left_anti"))
        seen = seen.unionByName(front)
    return seen.join(first, keys, "left_anti")


def route_rank(routes: DataFrame, recipes: DataFrame, now: Column, ttl_days: int) -> DataFrame:
    """Routes with a live recipe move to the front of their own layer; the order is stable otherwise."""
    live = recipes.where((F.col("recorded") <= now) & (F.datediff(now, "recorded") <= ttl_days)).select("route_id").distinct().withColumn("_hit", F.lit(1))
    w = Window.partitionBy("task_id", "layer").orderBy(F.desc(F.coalesce("_hit", F.lit(0))), "position")
    return routes.join(live, "route_id", "left").withColumn("place", F.row_number().over(w)).drop("_hit")


def ledger_consistency(claims: DataFrame, attempts: DataFrame, applicable: DataFrame | None = None) -> DataFrame:
    """Claims whose ledger contradicts their state.

    `claims` has (claim_id, state, accepted_at, n_failures); `attempts` (claim_id, outcome, completed_at).
    `applicable` (claim_id, route_id) are the routes a claim has; with it attempts have a route_id too, and a route
    without an attempt that has ended is untried. Without it a claim of no attempts cannot be told from one of no routes,
    and passes.
    """
    per = attempts.groupBy("claim_id").agg(
        F.bool_or(F.col("outcome") == "pending").alias("_open"), F.bool_or(F.col("outcome") == "blocked").alias("_blocked"), F.max("completed_at").alias("_last"), F.count(F.lit(1)).alias("_attempts"),
    )
    out = claims.join(per, "claim_id", "left")
    if applicable is None:
        out = out.withColumns({"_untried": F.lit(False), "_idle": F.lit(False)})
    else:
        untried = applicable.join(attempts.where("outcome <> 'pending'"), ["claim_id", "route_id"], "left_anti").select("claim_id").distinct()
        out = out.join(untried.withColumn("_untried", F.lit(True)), "claim_id", "left").withColumn("_idle", F.col("_attempts").isNull())
    accepted, exhausted = F.col("state") == "accepted", F.col("state") == "exhausted"
    rules = (
        ("accepted_with_failures", accepted & (F.col("n_failures") > 0)), ("accepted_with_open_routes", accepted & F.col("_open")),
        ("attempt_after_acceptance", accepted & (F.col("_last") > F.col("accepted_at"))), ("exhausted_with_open_routes", exhausted & F.col("_open")),
        ("exhausted_but_blocked", exhausted & F.col("_blocked")),
        ("exhausted_without_attempts", exhausted & F.col("_idle")), ("accepted_with_untried_routes", accepted & F.col("_untried")),
        ("exhausted_with_untried_routes", exhausted & F.col("_untried")),
    )
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]))
    return out.select("claim_id", found.alias("violations")).where(F.size("violations") > 0)


def period_windows(df: DataFrame, asof: Column, back: int = 5, ahead: int = 3) -> DataFrame:
    """Completed years a series must cover and forecast years it should, from its as-of date."""
    y = F.year(asof)
    return df.withColumns({"completed": F.sequence(y - back, y - 1), "forecast": F.sequence(y, y + ahead - 1)})
