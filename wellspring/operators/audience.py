"""Who may be told what: audiences, alert plans, listings and erasure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.functions import calendar as cal
from wellspring.functions.text import mask_phone, pretty_phone, to_ist
from wellspring.operators.lineage import cut_lineage

# Audience group of each role, bands of each bucket, languages.
ROLE_GROUP = {
    "farmer": "farmer",
    "society-manager": "society",
    "society-resident": "society",
    "government": "society",
}
BUCKET_BANDS = {"act_now": ("ACT NOW",), "monitor": ("MONITOR",), "all": ("ACT NOW", "MONITOR")}
LANGUAGES = ("mr", "hi", "en")

# Message wording of this project; a deployment passes its own table.
DEFAULT_TEMPLATES = [
    ("farmer", "ACT NOW", "en", "Water warning for {place}: score {score}/100. The well may run dry in about {days} days."),
    ("farmer", "ACT NOW", "hi", "{place}: जल तनाव {score}/100. लगभग {days} दिन शेष."),
    ("farmer", "ACT NOW", "mr", "{place}: पाणी ताण {score}/100. सुमारे {days} दिवस शिल्लक."),
    ("farmer", "MONITOR", "en", "Water notice for {place}: score {score}/100. Levels are falling."),
    ("farmer", "MONITOR", "hi", "{place}: जल तनाव {score}/100. स्तर घट रहा है."),
    ("farmer", "MONITOR", "mr", "{place}: पाणी ताण {score}/100. पातळी घटत आहे."),
    ("farmer", "SAFE", "en", "{place}: score {score}/100. No action needed."),
    ("farmer", "SAFE", "hi", "{place}: स्कोर {score}/100. कोई खतरा नहीं."),
    ("farmer", "SAFE", "mr", "{place}: गुण {score}/100. धोका नाही."),
    ("society", "ACT NOW", "en", "Water warning for {place}: score {score}/100, storage {level}, about {days} days of supply."),
    ("society", "ACT NOW", "hi", "{place}: जल तनाव {score}/100, भंडार {level}, लगभग {days} दिन."),
    ("society", "ACT NOW", "mr", "{place}: पाणी ताण {score}/100, साठा {level}, सुमारे {days} दिवस."),
    ("society", "MONITOR", "en", "Water notice for {place}: score {score}/100, storage {level}. Plan ahead."),
    ("society", "MONITOR", "hi", "{place}: जल तनाव {score}/100, भंडार {level}. योजना बनाएँ."),
    ("society", "MONITOR", "mr", "{place}: पाणी ताण {score}/100, साठा {level}. नियोजन करा."),
    ("society", "SAFE", "en", "{place}: score {score}/100, storage {level}. No action needed."),
    ("society", "SAFE", "hi", "{place}: स्कोर {score}/100, भंडार {level}. कोई खतरा नहीं."),
    ("society", "SAFE", "mr", "{place}: गुण {score}/100, साठा {level}. धोका नाही."),
]


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_TEMPLATES, "grp string, band string, lang string, template string")


def may_send(users: DataFrame) -> Column:
    role, verified = users["role"], users["verified"]
    return (role == "government") | ((role == "society-manager") & verified)


EVERYONE = "all"
#: Rows of a group, and pairs made by a task: one of two groups is about ``GROUP`` squared.
GROUP = 1 << 10
PAIRS_PER_TASK = 1 << 22


def audience_pointers(senders: DataFrame) -> DataFrame:
    """(sender_id, segment, entity_id): the one segment each sender may reach.

    A segment is everyone with a place (``all``) or the people of one entity
    (``entity``); its members are rows of the user table and are stored nowhere else.
    A sender who may not send has no segment.
    """
    segment = F.when(F.col("role") == "government", EVERYONE).when(F.col("entity_id").isNotNull(), "entity")
    return senders.where(F.coalesce(may_send(senders), F.lit(False))).select(
        F.col("user_id").alias("sender_id"), segment.alias("segment"), F.when(segment == "entity", F.col("entity_id")).alias("entity_id")
    ).where(F.col("segment").isNotNull())


def segment_sizes(users: DataFrame) -> DataFrame:
    """(segment, entity_id, members): everyone with a place, and the people of each entity."""
    people = users.where(F.col("entity_id").isNotNull())
    sizes = people.groupingSets([["entity_id"], []], "entity_id").agg(F.grouping("entity_id").alias("_all"), F.count(F.lit(1)).alias("members"))
    return sizes.select(F.when(F.col("_all") == 1, EVERYONE).otherwise("entity").alias("segment"), "entity_id", "members")


def audience(users: DataFrame, senders: DataFrame) -> DataFrame:
    """(sender_id, user) pairs of the entity senders given; senders who may not send reach nobody.

    This expands pointers on demand, for the senders that are about to send. Their
    number times their segment is the result; sizes of all senders come from ``reach``
    without pairs, and a government sender's audience is a filter
    (``government_audience``). Senders and people of an entity are dealt into groups of
    about ``GROUP`` each, and two groups meet in one place, so no task makes more than
    a few times ``PAIRS_PER_TASK`` pairs however large an entity is.
    """
    managers = audience_pointers(senders).where(F.col("segment") == "entity").select("sender_id", "entity_id")
    people = users.where(F.col("entity_id").isNotNull())
    theirs = managers.groupBy("entity_id").agg(F.count(F.lit(1)).alias("_senders"))
    sizes = people.groupBy("entity_id").agg(F.count(F.lit(1)).alias("_people")).join(theirs, "entity_id")
    groups = lambda n: F.ceil(F.col(n) / GROUP).cast("int")
    sizes = sizes.select("entity_id", "_people", "_senders", groups("_people").alias("_across"), groups("_senders").alias("_down"))
    sizes = cut_lineage(sizes)
    pairs = sizes.agg(F.sum(F.col("_people").cast("double") * F.col("_senders"))).first()[0] or 0.0
    tasks = max(int(users.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs // PAIRS_PER_TASK) + 1)

    def dealt(rows: DataFrame, who: str, own: str, other: str, at: str, beside: str) -> DataFrame:
        """Rows with the group each falls into, once for each group of the other side."""
        known = rows.join(sizes.select("entity_id", own, other), "entity_id")
        placed = known.withColumn(at, F.pmod(F.xxhash64(who), F.col(own)).cast("int"))
        spread = placed.withColumn(beside, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return spread.drop(own, other).repartition(tasks, "entity_id", "_i", "_j")

    left = dealt(people, "user_id", "_across", "_down", "_i", "_j")
    right = dealt(managers, "sender_id", "_down", "_across", "_j", "_i")
    met = left.join(right.hint("merge"), ["entity_id", "_i", "_j"]).where(F.col("user_id") != F.col("sender_id"))
    return met.select("entity_id", *[c for c in users.columns if c != "entity_id"], "sender_id")


def government_audience(users: DataFrame, sender_id: str) -> DataFrame:
    """Everyone with a place except one named sender: a filter, not a join."""
    return users.where((F.col("user_id") != sender_id) & F.col("entity_id").isNotNull()).withColumn(
        "sender_id", F.lit(sender_id)
    )


def reach(users: DataFrame, senders: DataFrame) -> DataFrame:
    """Audience size of every sender from its segment's size; no pairs are made.

    Senders who may not send (unverified managers) reach nobody.
    """
    pointers = audience_pointers(senders).withColumnsRenamed({"segment": "_segment", "entity_id": "_entity"})
    met = (F.col("segment") == F.col("_segment")) & F.col("entity_id").eqNullSafe(F.col("_entity"))
    sizes = pointers.join(segment_sizes(users), met).select("sender_id", "members")
    out = senders.select(F.col("user_id").alias("sender_id"), "role", F.col("entity_id").isNotNull().cast("int").alias("_own"))
    size = F.coalesce(F.col("members") - F.col("_own"), F.lit(0))
    return out.join(sizes, "sender_id", "left").select("sender_id", "role", size.cast("long").alias("audience"))


def subscriber_counts(people: DataFrame) -> DataFrame:
    return people.where(F.col("entity_id").isNotNull()).groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("subscribers")
    )


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replace ``{slot}`` by its value, a dash where the value is NULL."""
    out = template
    for slot, value in values.items():
        out = F.replace(out, F.lit("{" + slot + "}"), F.coalesce(value.cast("string"), F.lit("—")))
    return out


def role_group(role: Column) -> Column:
    return F.coalesce(cal.lookup(ROLE_GROUP, role), F.lit("farmer"))


def _text_of(people: DataFrame, column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) if column in people.columns else F.lit("")


def plan_alerts(
    people: DataFrame, cards: DataFrame, templates: DataFrame, bucket: str = "all", force: bool = False
) -> DataFrame:
    """One row per person: alert or skip, with the reason and the rendered body.

    ``cards``: entity_id, status, reason, score, band, days_to_crisis,
    headline. A bucket decides who is in scope; the wording follows each
    person's own band, role group and language. ``{place}`` is the person's entity
    label, or the place as they typed it; a ``{name}`` that is not known stays empty.
    A plan is made, nothing is sent.
    """
    own = cards.select(
        "entity_id", F.col("status").alias("_status"), F.col("reason").alias("_reason"),
        "score", "band", "days_to_crisis", "headline",
    )
    df = people.join(own, "entity_id", "left")
    wording = F.when(F.col("band").isin("SAFE", "MONITOR", "ACT NOW"), F.col("band")).otherwise("SAFE")
    df = df.withColumns({"grp": role_group(F.col("role")), "_wording": wording})
    df = df.join(templates.withColumnRenamed("band", "_wording"), ["grp", "_wording", "lang"], "left")
    scored = F.coalesce(F.col("_status") == "ok", F.lit(False))
    wanted = F.lit(True) if force else F.col("band").isin(*BUCKET_BANDS[bucket])
    body = fill_template(
        F.col("template"),
        {
            "name": _text_of(people, "name"), "place": F.coalesce(F.nullif("entity_label", F.lit("")), _text_of(people, "place_raw")),
            "score": F.col("score"), "days": F.col("days_to_crisis"), "level": F.col("headline"),
        },
    )
    worded = F.col("template").isNotNull()
    sends = scored & wanted & worded
    return df.select(
        "user_id", "entity_id", "role", "lang", "score", "band",
        F.when(sends, "planned").otherwise("skipped").alias("action"),
        F.when(~scored, F.coalesce("_reason", F.lit("no score")))
        .when(~wanted, "band not in bucket")
        .when(~worded, "no wording in this language")
        .alias("reason"),
        F.when(sends, F.when(F.col("band") == "ACT NOW", "caution").otherwise("notice")).alias("alert_type"),
        F.when(sends, body).alias("body"),
    )


def plan_counts(plan: DataFrame) -> DataFrame:
    return plan.agg(
        F.count(F.lit(1)).alias("audience"),
        F.count_if(F.col("action") == "planned").alias("planned"),
        F.count_if(F.col("alert_type") == "caution").alias("caution"),
        F.count_if(F.col("alert_type") == "notice").alias("notice"),
        F.count_if(F.col("action") == "skipped").alias("skipped"),
    )


def erase_users(
    users: DataFrame, alerts: DataFrame, erased: DataFrame, purge_alerts: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Users without the erased ones; their alerts detached, or purged."""
    gone = erased.select("user_id").distinct()
    left = users.join(gone, "user_id", "left_anti")
    if purge_alerts:
        return left, alerts.join(gone, "user_id", "left_anti")
    marked = alerts.join(gone.withColumn("_gone", F.lit(True)), "user_id", "left")
    kept = marked.withColumn("user_id", F.when(F.col("_gone").isNull(), F.col("user_id"))).drop("_gone")
    return left, kept.select(*alerts.columns)


def alert_counts(users: DataFrame, alerts: DataFrame) -> DataFrame:
    """Every user with their number of alerts, zero included.

    Alerts are counted per user before the join.
    """
    counts = alerts.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.count(F.lit(1)).alias("alerts"))
    return users.join(counts, "user_id", "left").na.fill(0, ["alerts"])


def user_listing(
    users: DataFrame, alerts: DataFrame, *, role: str | None = None, lang: str | None = None,
    place: str | None = None, since: str | None = None, auto_only: bool = False, full: bool = False,
) -> DataFrame:
    """Registered people with masked phones, local time, origin and alert count."""
    df = users
    if role:
        df = df.where(F.col("role") == role)
    if lang:
        df = df.where(F.col("lang") == lang)
    if place:
        where = F.lower(F.concat_ws(" ", F.coalesce("entity_label", F.lit("")), F.coalesce("place_raw", F.lit(""))))
        df = df.where(where.contains(place.lower()))
    if since:
        df = df.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    if auto_only:
        df = df.where(~F.col("has_password"))
    listed = alert_counts(df, alerts)
    return listed.select(
        "user_id",
        F.date_format(to_ist(F.col("created_at")), "yyyy-MM-dd HH:mm").alias("registered_ist"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("registered_utc"),
        "role", "name",
        (pretty_phone(F.col("phone")) if full else mask_phone(F.col("phone"))).alias("phone"),
        "lang",
        F.coalesce("entity_label", "place_raw", F.lit("—")).alias("place"),
        F.when(F.col("verified"), "yes").otherwise("NO").alias("verified"),
        F.when(F.col("has_password"), "signup").otherwise("auto").alias("origin"),
        "alerts",
    )


def user_tallies(users: DataFrame) -> DataFrame:
    """Counts by role, language, local day and origin in one table."""
    day = F.date_format(to_ist(F.col("created_at")), "yyyy-MM-dd")
    origin = F.when(F.col("has_password"), "signup").otherwise("auto")
    facets = F.array(
        *[F.struct(F.lit(n).alias("facet"), c.alias("value")) for n, c in
          (("role", F.col("role")), ("lang", F.col("lang")), ("day", day), ("origin", origin))]
    )
    return users.select(F.inline(facets)).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
