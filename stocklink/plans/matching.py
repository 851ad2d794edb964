"""Order lines against stock, end to end: features, candidates, scores, decision, fallback, reservation.

Each step is a DataFrame of its own, so it can be looked at, stored or
replaced.  Stock features and postings serve any number of order files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, fuzzy, tokens
from ..functions.dimensions import expanded, profile, profile_tags, retrieval_keys, structure_keys
from ..functions.features import features as read_features
from ..functions.features import review_comment, search_text
from ..functions.hints import Rules
from ..operators import allocate, compat, decide, feedback, memory, policy, preferences, retrieval
from ..session import stored

#: Keys whose tags find candidates as materials and as attributes; the others are dimensions.
MATERIAL_KEYS, ATTRIBUTE_KEYS, UNUSED_KEYS = ("mclass", "grade"), ("spec", "conn_gender", "subtype", "type", "connection"), ("family", "mclass", "conn_gender")
LIMIT = 5
#: An analog that scores less is looked for again in all stock.
SURE = 68.0
#: Similarities that a score is made of.
RATIOS = ("token_set_ratio", "ordered_ratio", "weighted_ratio", "partial_ratio", "token_sort_ratio")


def features(rows: DataFrame, id_column: str, parts: list[str], rules: Rules | None = None) -> DataFrame:
    """id, text, tags, dims, keys, roots, codes, sizes, structure, profile and the retrieval keys of rows described by the columns ``parts``."""
    raw = F.concat_ws(" ", *[F.col(p) for p in parts])
    # stored: what follows reads the features many times
    read = stored(rows.select(F.col(id_column).alias("id"), raw.alias("raw"), read_features([F.col(p) for p in parts], rules).alias("f")).select("id", "raw", "f.*"), "read-lines")
    staged = read.withColumn("dims", expanded(tokens.tags_by_key(F.col("tags"))))
    staged = staged.withColumns({"structure": structure_keys(F.col("dims"), F.col("tags"), F.col("keys"), F.col("text")), "profile_tags": profile_tags(profile(F.col("dims"), F.col("tags")))})
    of = lambda keys: F.filter("tags", lambda t: F.substring_index(t, ":", 1).isin(*keys))
    spread = F.flatten(F.transform(F.map_entries("dims"), lambda e: F.transform(e["value"], lambda v: F.concat(e["key"], F.lit(":"), v))))
    primary = F.filter(F.array_sort(tokens.tag_values(F.col("tags"), "family")), lambda f: f.isin(*fixed.PRIMARY_FAMILIES))
    return staged.select(
        "*", F.slice(retrieval_keys(F.col("structure")), 1, 6).alias("packed"), F.slice(primary, 1, 3).alias("families"), of(MATERIAL_KEYS).alias("materials"), of(ATTRIBUTE_KEYS).alias("attributes"),
        F.filter("tags", lambda t: ~F.substring_index(t, ":", 1).isin(*UNUSED_KEYS)).alias("raw_dimensions"), spread.alias("spread_dimensions"),
    )


_POSTED = {"code": "codes", "token": "keys", "root": "roots", "family": "families", "structure": "packed", "material": "materials", "attribute": "attributes"}


def stock_postings(stock: DataFrame) -> DataFrame:
    return retrieval.postings(stock, "id", _POSTED | {"dimension": "spread_dimensions"})


def candidates(orders: DataFrame, posted: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """line, id and the sources of each candidate; items with a learned signal are candidates too."""
    lines = stored(retrieval.postings(orders, "id", _POSTED | {"dimension": "raw_dimensions"}).withColumnRenamed("id", "line"), "line-postings")
    kind = lambda d, k: d.where(F.col("kind") == k)
    direct = retrieval.by_kind(lines.where(~F.col("kind").isin("token", "root")), posted)
    by_code = direct.where("source = 'code'").select("line", "id")
    by_token = stored(retrieval.pool_until(kind(lines, "token").select("line", "key"), kind(posted, "token").select("key", "id"), by_code, 8, 350), "by-token")
    base = by_code.unionByName(by_token).distinct()
    by_root = retrieval.pool_until(kind(lines, "root").select("line", "key"), kind(posted, "root").select("key", "id"), base, 6, 450, gate=200)
    pair = retrieval.pair_intersection(kind(lines, "dimension").select("line", "key"), kind(posted, "dimension").select("key", "id"))
    in_family = pair.join(direct.where("source = 'family'").select("line", "id"), ["line", "id"], "left_semi")
    marked = lambda d, source: d.select("line", "id").withColumn("source", F.lit(source))
    learned = [] if signals is None else [marked(signals, "memory")]
    return retrieval.merge_sources(direct, marked(by_token, "token"), marked(by_root, "root"), marked(pair, "dimension_pair"), marked(in_family, "family_dimension"), *learned)


_SIDE = ("id", "text", "tags", "tokens", "dims", "keys", "roots", "codes", "sizes", "packed")


def _side(d: DataFrame, p: str) -> DataFrame:
    return d.select(*[F.col(c).alias(f"{p}_{c}") for c in _SIDE])


def pairs_of(orders: DataFrame, stock: DataFrame, found: DataFrame) -> DataFrame:
    """The features of both sides of the candidates (line, id, sources)."""
    return found.join(_side(orders, "o"), F.col("line") == F.col("o_id")).join(_side(stock, "s"), F.col("id") == F.col("s_id"))


def every_pair(orders: DataFrame, stock: DataFrame) -> DataFrame:
    """All orders with all stock that their families allow: an order with a primary family meets items that have it, any other one all items."""
    o = _side(orders, "o").withColumn("family", F.array_min(F.filter(tokens.tag_values(F.col("o_tags"), "family"), lambda f: f.isin(*fixed.PRIMARY_FAMILIES))))
    s = _side(stock, "s")
    own = s.withColumn("family", F.explode(F.array_distinct(tokens.tag_values(F.col("s_tags"), "family"))))
    known = o.where("family is not null").join(own, "family").drop("family")
    open_ = o.where("family is null").drop("family").crossJoin(s)
    both = known.unionByName(open_)
    return both.select(F.col("o_id").alias("line"), F.col("s_id").alias("id"), F.array(F.lit("fallback")).alias("sources"), "*")


def scored(pairs: DataFrame, signals: DataFrame | None = None, policies: DataFrame | None = None, dice: bool = False) -> DataFrame:
    """Compatible pairs with their scores; ``signals`` (line, id, boost, allow) adds what was learned; ``dice`` takes the tokens' Dice for the set ratio."""
    if signals is not None:
        pairs = pairs.join(signals, ["line", "id"], "left")
    else:
        pairs = pairs.withColumn("boost", F.lit(0.0)).withColumn("allow", F.lit(False))
    pairs = pairs.fillna({"boost": 0.0, "allow": False}).withColumn("compatible", compat.compatible(F.col("o_tags"), F.col("s_tags"), F.col("o_dims"), F.col("s_dims")))
    fits = pairs.where(F.col("compatible") | F.col("allow"))
    if policies is not None:
        fits = policy.joined(fits, policies)
    else:
        fits = fits.withColumn("policy_family", F.lit(None).cast("string")).withColumn("policy", F.lit(None).cast(f"struct<{', '.join(c.replace(' ', ':', 1) for c in policy.POLICY.split(', '))}>"))
    # similarity is computed once for each pair of texts that is left
    texts = fits.select("o_text", "s_text").distinct()
    similar = texts.select("o_text", "s_text", fuzzy.column_scores(F.col("o_text"), F.col("s_text")).alias("similar")).select("o_text", "s_text", "similar.*")
    base = decide.dice_score(F.size(F.array_intersect("o_tokens", "s_tokens")), F.size("o_tokens"), F.size("s_tokens")) if dice else F.col("token_set_ratio")
    o_s = [F.col(c) for c in ("o_tags", "s_tags", "o_dims", "s_dims")]
    measured = fits.join(similar, ["o_text", "s_text"]).withColumn("base", base).select(
        "line", F.col("id").alias("stock_id"), "sources", "compatible", "boost", "allow", "base", *RATIOS, "policy", "policy_family", tokens.overlap(F.col("o_keys"), F.col("s_keys")).alias("overlap"), tokens.overlap(F.col("o_roots"), F.col("s_roots")).alias("root_overlap"),
        (F.size(F.filter(F.array_intersect("o_codes", "s_codes"), tokens.strong_code)) > 0).alias("code_hit"), F.arrays_overlap("o_sizes", "s_sizes").alias("size_pair_hit"), decide.dimension_scores(F.col("o_dims"), F.col("s_dims")).alias("d"),
        F.when(F.size("o_keys") > 0, F.size(F.filter(F.array_except("o_keys", "s_keys"), lambda t: F.length(t) >= 5)) / F.size("o_keys")).otherwise(0.0).alias("missing"), preferences.flange_preference(*o_s[:2]).alias("flange_bonus"),
        preferences.profile_bonus(*o_s).alias("profile_bonus"), compat.families(*o_s[:2]).alias("family_match"), compat.materials(*o_s[:2]).alias("material_match"), tokens.overlap(F.col("o_packed"), F.col("s_packed")).alias("structure_overlap"),
        "o_tags", "s_tags", "o_dims", "s_dims", "o_tokens", "s_tokens",
    ).select("*", "d.*")
    evidence = (F.col("overlap") >= 0.25) | (F.col("root_overlap") >= 0.35) | (F.col("bonus") >= 10) | F.col("code_hit")
    extra = F.when(evidence, fuzzy.rerank_bonus(F.col("weighted_ratio"), F.col("partial_ratio"), F.col("token_sort_ratio"))).otherwise(0.0) + F.col("flange_bonus") + F.col("profile_bonus")
    total = decide.total_score(F.col("base"), F.col("ordered_ratio"), F.col("overlap"), F.col("root_overlap"), F.col("code_hit"), F.col("bonus"), F.col("penalty"), F.col("missing"), extra, F.col("boost"))
    return judged(measured.withColumn("score", total)).drop("d", "base", "missing")


def judged(scores: DataFrame) -> DataFrame:
    """Scores with what the policies and the pipe rule say of each pair; the sides' features go."""
    pair = {c: F.col(c) for c in ("o_tags", "s_tags", "o_dims", "s_dims", "o_tokens", "s_tokens", "matched", "conflicting", "penalty", "score", "boost", "allow", "overlap", "root_overlap")}
    rule = F.col("policy")
    met = policy.meets(rule["safe_required"], *[pair[c] for c in ("o_tags", "s_tags", "o_dims", "s_dims", "conflicting")])
    flags = {
        "policy_exact": policy.exact_by_policy(rule, F.col("policy_family"), pair), "policy_analog": policy.analog_by_policy(rule, pair), "safe_met": met, "policy_forbidden": policy.forbidden(rule["forbid"], pair["o_tokens"], pair["s_tokens"]), "pipe": preferences.exact_pipe(pair),
        "generic": F.coalesce(rule["allow_exact"], F.lit(True)), "approval_only": F.coalesce(rule["approval_only"], F.lit(False)), "safe_min": F.when(F.size(rule["safe_required"]) > 0, rule["safe_min"]).otherwise(101.0),
        "review_met": F.coalesce(F.size(rule["safe_required"]) == 0, F.lit(True)) | met, "n_matched": F.size("matched"), "n_conflicting": F.size("conflicting"),
    }
    return scores.withColumns(flags).drop("o_tags", "s_tags", "o_dims", "s_dims", "o_tokens", "s_tokens", "policy")


_SHOWN = ("stock_id", "score", "approved", "boost", "sources", "compatible", "allow")


def decided(scores: DataFrame, reviewed: DataFrame | None = None, limit: int = LIMIT) -> DataFrame:
    """The chosen candidate of each line with kind, rule and reason, and the candidates worth showing; rejected ones don't take part."""
    marked = scores.withColumn("approved", F.lit(False)) if reviewed is None else feedback.reviewed(scores, reviewed, ["line", "stock_id"])
    top = decide.ranked(marked, limit)
    c = F.col
    verdict = decide.decision(c("score"), c("gap"), c("overlap"), c("root_overlap"), c("bonus"), c("penalty"), c("code_hit"), c("allow"), c("boost"), c("generic"), c("pipe"), F.array_contains("matched", "tripledn"), c("any_exact").isNotNull(), c("policy_analog"))
    safe = decide.analog_is_safe(c("score"), c("gap"), c("overlap"), c("root_overlap"), c("bonus"), c("penalty"), c("code_hit"), c("boost"), c("approved"), c("approval_only"), c("safe_met"), c("safe_min"), c("policy_forbidden"), c("review_met"))
    worth = compat.analog_filter(c("score"), c("overlap"), c("root_overlap"), c("bonus"), c("penalty"), c("code_hit"), c("approved"), c("boost") > 0, c("allow"))
    # at most ``limit`` rows a line are gathered
    shown = F.struct("rank", *_SHOWN, worth.alias("worth"), F.col("policy_family"), "matched", "conflicting")
    gathered = top.groupBy("line").agg(F.array_sort(F.collect_list(shown)).alias("all"), F.min(F.when(F.col("policy_exact"), F.col("rank"))).alias("any_exact"))
    best = top.where("rank = 1").join(gathered, "line").withColumn("v", verdict).withColumn("safe", safe)
    at = F.when(c("v.rule") == 2, c("any_exact")).otherwise(1)
    chosen = F.element_at("all", at)
    words = F.create_map(*[x for k, v in fixed.RULE_REASONS.items() for x in (F.lit(k), F.lit(v))])
    reason = F.when(c("v.rule") == 2, policy.reason(chosen["policy_family"], True)).when(c("v.rule") == 7, policy.reason(c("policy_family"), False)).otherwise(F.element_at(words, c("v.rule")))
    listed = F.when(c("v.kind") == "exact", F.slice("all", 2, 3)).otherwise(F.slice("all", 1, 4))
    kept = F.filter(listed, lambda x: x["worth"])
    analogs = F.when((c("v.kind") == "analog") & (F.size(kept) == 0), F.slice("all", 1, 1)).otherwise(kept)
    return best.select(
        "line", chosen["stock_id"].alias("stock_id"), chosen["score"].alias("score"), "gap", chosen["matched"].alias("matched"), chosen["conflicting"].alias("conflicting"), chosen["sources"].alias("sources"), "v.kind", "v.rule", reason.alias("reason"), "safe",
        F.transform(analogs, lambda x: x["stock_id"]).alias("analogs"), F.transform("all", lambda x: F.struct(*[x[k].alias(k) for k in _SHOWN])).alias("candidates"),
    )


def weak_lines(orders: DataFrame, verdicts: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """Orders whose best candidate is none, no match, or an analog below ``SURE``; not those with a learned signal in their favour."""
    sure = verdicts.where((F.col("kind") == "exact") | (F.col("kind") != "not_found") & (F.col("score") >= SURE)).select(F.col("line").alias("id"))
    weak = orders.join(sure, "id", "left_anti")
    return weak if signals is None else weak.join(signals.where("boost > 0").select(F.col("line").alias("id")), "id", "left_anti")


def fallback(weak: DataFrame, stock: DataFrame, reviewed: DataFrame | None = None, policies: DataFrame | None = None) -> DataFrame:
    """Verdicts of the weak lines over all stock, with no cut and nothing learned."""
    return decided(stored(scored(every_pair(weak, stock), None, policies, dice=True), "fallback-scores"), reviewed)


def better(first: DataFrame, second: DataFrame) -> DataFrame:
    """Of two verdicts of a line the second, if it is the first exact one, the first match at all, or scores higher."""
    one = lambda d, k: d.select("line", F.struct(*[c for c in d.columns if c != "line"]).alias(k))
    a, b = (F.col(k) for k in ("a", "b"))
    kind = F.coalesce(a["kind"], F.lit("not_found"))
    wins = (b["kind"] == "exact") & (kind != "exact") | (b["kind"] != "not_found") & (kind == "not_found") | (b["score"] > F.coalesce(a["score"], F.lit(0.0)))
    taken = F.coalesce(wins, F.lit(False))
    picked = F.when(a.isNull() | taken, F.coalesce("b", "a")).otherwise(a)
    return one(first, "a").join(one(second, "b"), "line", "full").select("line", picked.alias("v"), b.isNotNull().alias("fallback_used"), (a.isNotNull() & taken).alias("fallback_replaced")).select("line", "v.*", "fallback_used", "fallback_replaced")


def matched(lines: DataFrame, stock: DataFrame, verdicts: DataFrame, order: list[str]) -> DataFrame:
    """Every line (id, requested and the columns of ``order``) with status, item, comment and what was reserved of the item's quantity."""
    joined = lines.join(verdicts.withColumnRenamed("line", "id"), "id", "left").join(stock.select(F.col("id").alias("stock_id"), "quantity"), "stock_id", "left")
    exact = joined.where("kind = 'exact'")
    reserved = allocate.reserve(exact, ["stock_id"], [F.col(c) for c in order], "requested", "quantity").drop("before").withColumn("status", allocate.line_status(F.col("requested"), F.col("allocated")))
    told = F.when(F.col("status") == allocate.PARTIAL, F.concat("reason", F.lit(fixed.PARTIAL_SUFFIX))).when(F.col("status") == allocate.DEPLETED, F.lit(fixed.DEPLETED_REASON)).otherwise(F.col("reason"))
    rest = joined.where("kind is null or kind != 'exact'").withColumn("allocated", F.lit(0.0)).withColumn("status", F.when(F.col("kind") == "analog", F.when(F.col("safe"), allocate.SAFE).otherwise(allocate.APPROVAL)).otherwise(allocate.NOT_FOUND))
    return reserved.withColumn("comment", told).unionByName(rest.withColumn("comment", F.coalesce("reason", F.lit(fixed.RULE_REASONS[0]))))


def reviewed_comments(results: DataFrame, raw: Column, search: Column, rules: Rules) -> DataFrame:
    """Results with the comment of the review rule, for lines that found nothing worth showing."""
    rule = review_comment(raw, search, rules)
    open_ = (F.col("status") == allocate.NOT_FOUND) & (F.size(F.coalesce("analogs", F.array().cast("array<long>"))) == 0)
    return results.withColumn("_rule", rule).withColumn("comment", F.when(open_, F.coalesce("_rule.comment", "comment")).otherwise(F.col("comment"))).drop("_rule")


def learned_signals(orders: DataFrame, entries: DataFrame, stock: DataFrame, parts_text: Column, rules: Rules | None = None) -> DataFrame:
    """Signals of the memory for orders that ``features`` read; ``stock`` has id and code."""
    asked = orders.select(F.col("id").alias("line"), "text", "keys", "roots", "tags", "structure", "profile_tags", F.array_distinct(F.array("text", search_text(parts_text, rules))).alias("query_keys"))
    return memory.signals(asked, entries, stock)


def match(
    lines: DataFrame, stock: DataFrame, line_parts: list[str], stock_parts: list[str], order: list[str], reviewed: DataFrame | None = None, signals: DataFrame | None = None, policies: DataFrame | None = None, rules: Rules | None = None, entries: DataFrame | None = None
) -> DataFrame:
    """All steps for lines (id, requested, parts, order) and stock (id, quantity, parts); items without quantity take no part.

    ``reviewed`` is (line, stock_id, decision); ``entries`` is a memory that
    ``memory.complete`` made, for which the stock needs a code, and gives the
    signals unless they are given.
    """
    on_hand = stock.where("quantity > 0")
    # features feed postings, retrieval and scores
    line_features, stock_features = stored(features(lines.where("requested > 0"), "id", line_parts, rules), "line-features"), stored(features(on_hand, "id", stock_parts, rules), "stock-features")
    if signals is None and entries is not None:
        signals = stored(learned_signals(line_features, entries, on_hand, F.col("raw"), rules), "signals")
    found = stored(candidates(line_features, stored(stock_postings(stock_features), "postings"), signals), "candidates")
    scores = stored(scored(pairs_of(line_features, stock_features, found), signals, policies), "scores")
    verdicts = stored(decided(scores, reviewed), "verdicts")
    again = stored(fallback(stored(weak_lines(line_features, verdicts, signals), "weak-lines"), stock_features, reviewed, policies), "fallback-verdicts")
    results = matched(lines, on_hand, better(verdicts, again), order)
    if rules is None or not rules.reviews:
        return results
    texts = line_features.select("id", F.col("raw").alias("_raw"), F.col("text").alias("_text"))
    return reviewed_comments(results.join(texts, "id", "left"), F.col("_raw"), F.col("_text"), rules).drop("_raw", "_text")


def traces(results: DataFrame) -> DataFrame:
    """How each line was decided, with a row for each candidate that was ranked: where it came from, whether it is compatible or only allowed, what was learned, and its score."""
    shown = results.select("id", "kind", "rule", "reason", "status", "fallback_used", "fallback_replaced", F.size("candidates").alias("ranked"), F.posexplode_outer("candidates").alias("place", "c"))
    return shown.select(
        "id", F.col("kind").alias("decision_kind"), F.col("rule").alias("decision_rule"), F.col("reason").alias("decision_reason"), F.col("status").alias("final_status"), "fallback_used", "fallback_replaced", F.col("ranked").alias("ranked_candidate_count"), "place", "c.stock_id",
        F.col("c.sources").alias("retrieval_paths"), F.col("c.compatible").alias("compatibility_passed"), (~F.col("c.compatible") & F.col("c.allow")).alias("manual_override_used"), F.when(F.col("c.approved"), "approved").otherwise("").alias("review_decision"), F.col("c.boost").alias("manual_learning_boost"), F.col("c.score").alias("score"),
    )
