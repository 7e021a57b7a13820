"""Claims: from sentences or raw fields to checked rows, what state each is about, relations between them, expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bucket_key, label, sentences, short_hash, time_label
from .lineage import cut

#: The roles a time may have in a claim, and other names for them.
TIME_ROLES = ("occurred_at", "mentioned_at", "updated_at", "planned_for", "deadline_at", "valid_from", "started_at", "completed_at", "finalized_at")
ROLE_ALIASES = {"claim_time": "mentioned_at", "date": "occurred_at", "deadline": "deadline_at", "due_at": "deadline_at", "finish_at": "completed_at", "finished_at": "completed_at", "plan_for": "planned_for", "session_date_time": "occurred_at", "start_at": "started_at"}
#: Facets of claims, those that last, and roles that no lasting state has.
FACETS = ("activity", "date", "education", "event", "family", "health", "identity", "location", "occupation", "plan", "place", "possession", "preference", "relationship", "status", "time", "travel", "work", "other")
LASTING = ("education", "family", "health", "identity", "location", "occupation", "place", "possession", "preference", "relationship", "status", "work")
PASSING_ROLES = ("completed_at", "deadline_at", "finalized_at", "occurred_at", "planned_for")
BOUNDARY_ROLES = ("started_at", "updated_at", "valid_from")
#: Facets that are looked for in a sentence, in order.
SENTENCE_FACETS = ("constraint", "deadline", "decision", "link", "metric", "next_step", "owner", "preference", "priority", "risk", "role", "scope", "skill", "state", "status", "style")
#: Patterns of wording.
PAST_TIME = r"(?i)\b(?:ago|earlier|last\s+(?:day|night|week|month|year|mon(?:day)?|tues?(?:day)?|wednes(?:day)?|thurs?(?:day)?|fri(?:day)?|satur(?:day)?|sun(?:day)?)|previous(?:ly)?|yesterday)\b"
PAST_ONLY = r"(?i)\b(?:formerly|previously|used\s+to)\b"
CURRENT_CUE = r"(?i)\b(?:currently|no\s+longer|now|still)\b"
RESIDENCE = r"(?i)\b(?:home|live|lives|lived|living|move|moved|moving|reside|resides|resided|residing)\b"
STATE_WORDS = r"(?i)\b(owner|responsible|deadline|due|status|state|decision|constraint|risk|priority|prefer|next step|plan|role|skill|metric|percent|completed|finished|started|updated|now)\b"
UPDATE_WORDS = r"(?i)\b(now|updated?|changed?|replaced?|corrected?|instead|no longer|currently)\b"
#: States with one slot, and targets that only repeat a domain.
ONE_SLOT = {"location": "residence", "occupation": "primary"}
GENERIC = {
    "activity": ("activity", "current_activity"),
    "education": ("education", "educational_status"),
    "family": ("family", "family_relationship", "family_status"),
    "health": ("health", "condition", "health_condition", "medical_condition"),
    "identity": ("identity", "attribute", "personal_attribute"),
    "place": ("place", "location"),
    "possession": ("possession", "possessions", "belonging", "belongings"),
    "preference": ("preference", "preferences", "interest", "interests"),
    "relationship": ("relationship", "relationship_status"),
    "status": ("status", "current_status"),
}
OBJECT_SCOPED = ("activity", "education", "family", "health", "identity", "place", "possession", "preference", "relationship", "status")


def one_of(text: Column, values: tuple[str, ...], aliases: dict[str, str] | None = None, otherwise: str = "") -> Column:
    """The text as a key, by its alias where it has one; `otherwise` if it is none of the values. Null counts as empty."""
    key = bucket_key(text, "")
    named = F.coalesce(F.create_map(*[F.lit(x) for pair in (aliases or {"": ""}).items() for x in pair])[key], key)
    return F.when(named.isin(*values), named).otherwise(otherwise)


def facet(text: Column) -> Column:
    return one_of(text, FACETS, otherwise="other")


def time_role(role: Column, time: Column) -> Column:
    """The role by its name or alias; what is planned for a time in the past occurred."""
    named = one_of(role, TIME_ROLES, ROLE_ALIASES)
    return F.when((named == "planned_for") & time_label(time).rlike(PAST_TIME), "occurred_at").otherwise(named)


def role_and_time(role: Column, time: Column) -> Column:
    """(role, time) of a claim: a time without a role occurred then, a role without a time is none."""
    named, at = time_role(role, time), time_label(time)
    return F.struct(F.when(at == "", "").when(named == "", "occurred_at").otherwise(named).alias("role"), at.alias("time"))


def from_sentences(events: DataFrame, limit: int) -> DataFrame:
    """At most `limit` claims an event (event_id, text, speaker): its sentences with a state word, in order.

    Facet: the first one named, due for deadline, responsible for owner, else status. Subject: a capitalised phrase
    before a verb, else the speaker. Null and empty texts give none. Done by array functions, row by row: no shuffle.
    """

    def claim(s: Column) -> Column:
        low = F.lower(s)
        kind = F.when(F.lit(False), "")
        for f in SENTENCE_FACETS:
            kind = kind.when(F.contains(low, F.lit(f.replace("_", " "))), f)
        kind = kind.when(F.contains(low, F.lit("due")), "deadline").when(F.contains(low, F.lit("responsible")), "owner").otherwise("status")
        named = F.regexp_extract(s, r"^\s*([A-Z][A-Za-z0-9 _-]{1,80}?)\s+(?:is|are|has|have|will|should|must)\b", 1)
        return F.struct(
            F.coalesce(F.nullif(F.regexp_replace(named, r"\s+", " "), F.lit("")), F.col("speaker")).alias("subject"), kind.alias("facet"), s.alias("value"),
            F.when(s.rlike(UPDATE_WORDS), "updated_at").otherwise("mentioned_at").alias("role"), F.lit(0.6).alias("confidence"),
        )

    told = F.filter(F.transform(sentences(F.col("text")), lambda s: F.regexp_replace(s, r"\s+", " ")), lambda s: s.rlike(STATE_WORDS))
    return events.select("event_id", F.posexplode(F.transform(F.slice(told, 1, limit), claim)).alias("i", "c")).select("event_id", (F.col("i") + 1).alias("number"), "c.*")


def normalised(raw: DataFrame, events: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of raw claims (event_id, ord, subject, facet, value, role, time).

    Accepted: of a known event, with subject and value, the first `limit` of each event; rejected rows have a reason.
    """
    known = events.select("event_id", F.lit(True).alias("_known")).distinct()
    fields = raw.join(known, "event_id", "left").withColumns({"subject": label(F.col("subject")), "value": label(F.col("value")), "facet": facet(F.col("facet")), "_rt": role_and_time(F.col("role"), F.col("time"))})
    reason = F.when(F.col("_known").isNull(), "unknown_event").when(F.col("subject") == "", "no_subject").when(F.col("value") == "", "no_value")
    judged = fields.withColumn("reason", reason)
    by = Window.partitionBy("event_id", F.col("reason").isNull()).orderBy("ord")
    judged = judged.withColumn("number", F.row_number().over(by)).withColumn("reason", F.coalesce("reason", F.when(F.col("number") > limit, "limit")))
    rows = judged.select("event_id", "ord", "number", "subject", "facet", "value", F.col("_rt.role").alias("role"), F.col("_rt.time").alias("time"), "reason")
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").drop("number")


def lasting(facet_: Column, role: Column, value: Column) -> Column:
    """Whether a claim tells a state that lasts: no passing role, no wording of the past alone, a lasting facet (or an activity's bound)."""
    value = F.coalesce(value, F.lit(""))
    past = value.rlike(PAST_ONLY) & ~value.rlike(CURRENT_CUE)
    role = F.coalesce(role, F.lit(""))
    return ~role.isin(*PASSING_ROLES) & ~past & (facet_.isin(*LASTING) | ((facet_ == "activity") & role.isin(*BOUNDARY_ROLES)))


def domain(facet_: Column, value: Column) -> Column:
    return F.when((facet_ == "place") & F.coalesce(value, F.lit("")).rlike(RESIDENCE), "location").when(facet_ == "work", "occupation").otherwise(facet_)


def generic_target(target: Column, facet_: Column, domain_: Column, owner: Column) -> Column:
    """Whether a target only repeats the domain or facet, alone or after its owner's name."""
    t, o = bucket_key(target, ""), bucket_key(owner, "")
    more = F.create_map(*[x for k, v in GENERIC.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])[domain_]
    coarse = F.concat(F.array(domain_, facet_), F.coalesce(more, F.array().cast("array<string>")))
    bare = F.array_append(F.transform(F.array(F.concat(o, F.lit("_s_")), F.concat(o, F.lit("_"))), lambda p: F.when((o != "") & F.startswith(t, p), F.substr(t, F.length(p) + 1)).otherwise(t)), t)
    return F.arrays_overlap(bare, coarse)


def dimension(facet_: Column, value: Column, topics: Column, owner: Column, claim_id: Column) -> Column:
    """What state a claim is about, as domain:target: the domain's one slot, its only topic, else a target of the claim alone."""
    dom = domain(facet_, value)
    slot = F.create_map(*[F.lit(x) for pair in ONE_SLOT.items() for x in pair])[dom]
    keys = F.array_distinct(F.filter(F.transform(F.coalesce(topics, F.array().cast("array<string>")), lambda x: bucket_key(x, "")), lambda k: k != ""))
    topic = F.when(dom.isin(*OBJECT_SCOPED) & (F.size(keys) == 1) & ~generic_target(F.get(keys, F.lit(0)), facet_, dom, owner), F.get(keys, F.lit(0)))
    alone = F.concat(F.lit("claim_local_"), F.substring(bucket_key(value, "unresolved"), 1, 56), F.lit("_"), short_hash(claim_id, 8))
    return F.concat_ws(":", dom, F.coalesce(slot, topic, alone))


def relations(raw: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of raw relations (type, src, dst) between claims (claim_id, at).

    Accepted once each, conflicts by their sorted ends: known types and ends that differ, from later to earlier (or
    equal) time, and pairs with one type only. Rejected rows have a reason. A null end is unknown.
    """
    kind = F.upper(F.trim(F.coalesce("type", F.lit(""))))
    ends = claims.select("claim_id", "at").dropDuplicates(["claim_id"])
    rows = raw.select(kind.alias("type"), "src", "dst")
    rows = rows.join(ends.select(F.col("claim_id").alias("src"), F.col("at").alias("_from"), F.lit(True).alias("_s")), "src", "left").join(ends.select(F.col("claim_id").alias("dst"), F.col("at").alias("_to"), F.lit(True).alias("_d")), "dst", "left")
    reason = (
        F.when(~F.col("type").isin("CORRECTS", "SUPERSEDES", "CONFLICTS_WITH"), "unknown_type").when(F.col("_s").isNull() | F.col("_d").isNull(), "unknown_end")
        .when(F.col("src") == F.col("dst"), "same_end").when((F.col("type") != "CONFLICTS_WITH") & (F.col("_from") < F.col("_to")), "reversed")
    )
    flip = (F.col("type") == "CONFLICTS_WITH") & (F.col("src") > F.col("dst"))
    judged = rows.select("type", F.when(flip, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(flip, F.col("src")).otherwise(F.col("dst")).alias("dst"), reason.alias("reason")).distinct()
    pair = Window.partitionBy("reason", F.least("src", "dst"), F.greatest("src", "dst"))
    kinds = F.when(F.col("reason").isNull() & (F.min("type").over(pair) != F.max("type").over(pair)), "mixed_types")
    judged = judged.withColumn("reason", F.coalesce("reason", kinds))
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def leaks(df: DataFrame, banned: tuple[str, ...]) -> list[str]:
    """Names of columns and nested fields that a table must not carry, by its schema alone."""

    def names(t) -> list[str]:
        t = getattr(t, "elementType", None) or getattr(t, "valueType", None) or t
        return [n for f in getattr(t, "fields", []) for n in (f.name, *names(f.dataType))]

    return sorted({n for n in names(df.schema) if n.lower() in banned})


def expand_related(seeds: DataFrame, edges: DataFrame, claims: DataFrame, hops: int, decay: float = 0.7) -> DataFrame:
    """(query_id, claim_id, hop, relevance): what seeds (query_id, claim_id, relevance) reach over relations (src, dst).

    A relation is crossed, in both directions, only between claims (claim_id, subject, dimension) that share subject and
    dimension, or that both lack them. Relevance decays by `decay` a hop; a claim keeps its first hop and best relevance.
    Each hop joins the frontier alone and is written.
    """
    keyed = claims.select("claim_id", F.struct("subject", "dimension").alias("_key"))
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    of = lambda name: keyed.select(F.col("claim_id").alias(name), F.col("_key").alias(f"_k_{name}"))
    open_ = both.join(of("src"), "src").join(of("dst"), "dst").where("_k_src <=> _k_dst").select("src", "dst")
    seen = seeds.groupBy("query_id", "claim_id").agg(F.max("relevance").alias("relevance")).select("query_id", "claim_id", F.lit(0).alias("hop"), "relevance")
    frontier = seen
    for hop in range(1, hops + 1):
        step = frontier.join(open_, F.col("claim_id") == F.col("src")).groupBy("query_id", F.col("dst").alias("claim_id")).agg((F.max("relevance") * decay).alias("relevance"))
        frontier = cut(step.join(seen.select("query_id", "claim_id"), ["query_id", "claim_id"], "left_anti").select("query_id", "claim_id", F.lit(hop).alias("hop"), "relevance"))
        seen = seen.unionByName(frontier)
    return seen


def state_priority(rank: Column, relevance: Column, hop: Column) -> Column:
    """Order of states in a context: near ranks and high relevance first, each hop costs."""
    return 1 / (1 + 0.25 * (rank - 1)) + 0.75 * relevance - 0.25 * hop


def anchored_states(hits: DataFrame, support: DataFrame, n: int) -> DataFrame:
    """(query_id, state_id, rank): states supported (state_id, claim_id) by a query's first n hits (query_id, claim_id, rank), by best rank."""
    return hits.where(F.col("rank") <= n).join(support, "claim_id").groupBy("query_id", "state_id").agg(F.min("rank").alias("rank"))


def select_states(hits: DataFrame, states: DataFrame, scopes: DataFrame, limit: int) -> DataFrame:
    """The best `limit` states of a query: hits (query_id, state_id, score) on states (state_id, scope_id, validity) in its scopes (query_id, scope_id); validity adds to the score."""
    in_scope = hits.join(states, "state_id").join(scopes.distinct(), ["query_id", "scope_id"], "left_semi")
    best = in_scope.groupBy("query_id", "state_id").agg(F.max(F.col("score") + F.coalesce("validity", F.lit(0.0))).alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "state_id"))).where(F.col("rank") <= limit)


def state_graph(clusters: DataFrame, support: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of folded clusters (state_id, owner, primary_claim, status, at) and their support (state_id, claim_id).

    Nodes: states whose primary claim is in their support. Edges: SUPPORTS of each claim, CURRENT_AFTER to the day and
    CURRENT_STATE_OF to the owner of each current state.
    """
    held = clusters.join(support.select("state_id", F.col("claim_id").alias("primary_claim")).distinct(), ["state_id", "primary_claim"], "left_semi")
    sid = F.concat(F.lit("state::"), F.col("state_id"))
    supports = support.join(held.select("state_id"), "state_id", "left_semi").select(F.lit("SUPPORTS").alias("type"), F.concat(F.lit("claim::"), F.col("claim_id").cast("string")).alias("src"), sid.alias("dst"))
    now = held.where("status = 'current'")
    after = now.where("at is not null").select(F.lit("CURRENT_AFTER").alias("type"), sid.alias("src"), F.concat(F.lit("time::"), F.date_format("at", "yyyy-MM-dd")).alias("dst"))
    of = now.select(F.lit("CURRENT_STATE_OF").alias("type"), sid.alias("src"), F.concat(F.lit("subject::"), F.col("owner").cast("string")).alias("dst"))
    return held.select(sid.alias("id"), F.lit("state").alias("node_type"), "status"), supports.unionByName(after).unionByName(of).distinct()
