"""Who a claim is about: subject keys with aliases, owners of claims, and the gate that compares them with a question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Subjects that mean the speaker.
SELF = ("i", "me", "my", "myself")
#: Marks that are no part of a name's ends.
_ENDS = r"[ \t\r\n'\"`.,:;!?()\[\]{}]+"
_NAME = r"^[A-Za-z][A-Za-z'-]*(?: [A-Za-z][A-Za-z'-]*){0,3}$"


def _label(value: Column) -> Column:
    bare = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"\s+", " ")
    return F.substring(F.regexp_replace(bare, f"^{_ENDS}|{_ENDS}$", ""), 1, 180)


def _key(label: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(label), r"[^a-z0-9]+", "_"), r"^_+|_+$", ""), 1, 100)


def subject_keys(claims: DataFrame, within: Sequence[str] = (), subject_col: str = "subject", speaker_col: str = "speaker") -> DataFrame:
    """claims with subject_key and canonical_subject. I, me and my mean the speaker, an empty subject too; a possessive ending
    goes. A name of one word takes the key of the only longer name (of plain letters, four words at most) that starts with
    it; where several do it stays apart. The canonical subject is the longest label of a key, later in the alphabet among
    equals. Aliases hold within the columns `within`, whose nulls are one value. Names are joined after they are aggregated.
    """
    said, speaker = _label(F.col(subject_col)), _label(F.col(speaker_col))
    raw = F.when((said == "") | F.lower(said).isin(*SELF), F.when(speaker != "", speaker).otherwise(said)).otherwise(said)
    label = F.regexp_replace(raw, r"^([A-Za-z][A-Za-z'-]*)['’]s$", "$1")
    rows = claims.withColumn("_label", label).withColumn("_key", _key(F.col("_label")))
    plain = F.col("_label").rlike(_NAME) & ~F.col("_label").rlike(r"(?i)['’]s\b")
    names = rows.select(*within, "_label", "_key", plain.alias("_plain")).groupBy(*within, "_key").agg(F.max("_plain").alias("_plain"), F.max(F.struct(F.length("_label"), F.lower("_label"), "_label")).alias("_best"))
    long = names.where("_plain and instr(_key, '_') > 0").groupBy(*within, F.split("_key", "_")[0].alias("_short")).agg(F.count(F.lit(1)).alias("_n"), F.min("_key").alias("_full"))
    a, b = names.alias("a"), long.where("_n = 1").alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in within] + [F.col("a._key") == F.col("b._short"), F.col("a._plain")]
    told = a.join(b, on, "left").select("a.*", F.coalesce("b._full", "a._key").alias("subject_key"))
    best = told.groupBy(*within, "subject_key").agg(F.max("_best")["_label"].alias("canonical_subject"))
    whole = told.alias("t").join(best.alias("u"), [F.col(f"t.{c}").eqNullSafe(F.col(f"u.{c}")) for c in within] + [F.col("t.subject_key") == F.col("u.subject_key")])
    whole = whole.select(*[F.col(f"t.{c}").alias(c) for c in within], "t._key", "t.subject_key", "canonical_subject")
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"w.{c}")) for c in within] + [F.col("r._key") == F.col("w._key")]
    return rows.alias("r").join(whole.alias("w"), on).select(*[F.col(f"r.`{c}`") for c in claims.columns], "w.subject_key", "w.canonical_subject")


def claim_owners(claims: DataFrame, participants: DataFrame) -> DataFrame:
    """(claim_id, owner): the participant (column name) that a claim's subject names, else its speaker if a participant; other
    claims have none. Names are compared without case and marks around."""
    known = participants.select(_key(_label(F.col("name"))).alias("k")).where("k <> ''").distinct()
    values = claims.select("claim_id", F.posexplode(F.array(_key(_label(F.col("subject"))), _key(_label(F.col("speaker"))))).alias("turn", "k"))
    return values.join(known, "k").groupBy("claim_id").agg(F.min_by("k", "turn").alias("owner"))


def participant_binding(questions: DataFrame, cited: DataFrame) -> DataFrame:
    """(query_id, status, blocked) of questions (query_id, participants) against cited owners (query_id, owner): blocked where
    both are known and none is shared. Owners are few, as they are a dialogue's participants."""
    own = cited.where("owner is not null").groupBy("query_id").agg(F.collect_set("owner").alias("owners"))
    asked = F.coalesce(F.filter("participants", lambda x: x.isNotNull()), F.array().cast("array<string>"))
    unknown = (F.size(asked) == 0) | F.col("owners").isNull()
    status = F.when(unknown, "not_applicable").when(F.arrays_overlap(asked, "owners"), "supported_participant").otherwise("contradicted_participant")
    return questions.join(own, "query_id", "left").select("query_id", status.alias("status"), (status == "contradicted_participant").alias("blocked"))
