"""Guidance on cancelling: the best match of a name over the aliases of two tables of guides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions import text
from ledgerlight.operators.registry import upserted

COLUMNS = ["#", "Provider", "Market Position", "Price Range", "Billing Cycle", "Website", "Cancellation Process", "additional resources"]
SCHEMA = "`#` int, Provider string, `Market Position` string, `Price Range` string, `Billing Cycle` string, Website string, `Cancellation Process` string, `additional resources` string"
SHEET = "LLM Web Search"
#: Names of guides that are sent to the executors at once; more of them go in blocks.
FEW = 100_000

# The built-in guides (service, aliases, page to manage it, source, steps, notes).
BUILT_IN = [
    (
        "iCloud+", ["icloud+", "icloud", "icloud plus"], "https://account.apple.com/", "https://support.apple.com/en-us/118428",
        [
            "On iPhone or iPad, open Settings, tap your name, then tap Subscriptions.",
            "Select iCloud+ or iCloud, then tap Cancel Subscription or downgrade the storage plan.",
            "On Mac, open App Store, click your name, open Account Settings, then manage Subscriptions.",
            "Without an Apple device, sign in at account.apple.com or use reportaproblem.apple.com for recent iCloud+ charges.",
        ],
        ["Use the same Apple Account shown on the receipt.", "If the subscription belongs to a family member, that account owner has to cancel it."],
    ),
    (
        "Apple / App Store", ["apple", "apple com bill", "itunes", "app store"], "https://account.apple.com/", "https://support.apple.com/en-us/118428",
        [
            "On iPhone or iPad, open Settings, tap your name, then tap Subscriptions.",
            "Choose the subscription and tap Cancel Subscription.",
            "On Mac, open App Store, click your name, open Account Settings, then manage Subscriptions.",
            "On Windows, use Apple Music, Apple TV, or iTunes account settings to manage subscriptions.",
        ],
        ["If there is no Cancel button, Apple says the subscription is already canceled.", "If the charge was billed by another company, cancel through that biller instead."],
    ),
    (
        "Netflix", ["netflix", "nflx", "netflix com"], "https://www.netflix.com/cancelplan", "https://help.netflix.com/en/node/407",
        ["Sign in to Netflix and open the cancel or membership management page.", "Select Cancel.", "Select Finish Cancellation and watch for the confirmation email."],
        ["Signing out or deleting the app does not cancel Netflix.", "If Netflix says a payment partner manages billing, cancel through that partner."],
    ),
    (
        "Spotify", ["spotify", "spotify premium", "spotify usa"], "https://www.spotify.com/account/subscription/", "https://support.spotify.com/us/article/cancel-premium/",
        ["Sign in to Spotify and open Manage your plan.", "Select Cancel subscription.", "Confirm the cancellation flow; Premium stays active until the next billing date."],
        ["If there is no cancel option, check the Payment section for the partner company that bills you.", "Plan members in Duo or Family plans need the plan manager to cancel the paid plan."],
    ),
    (
        "Adobe", ["adobe", "adobe creative", "adobe creative cloud"], "https://account.adobe.com/plans",
        "https://helpx.adobe.com/account/individual/subscriptions-and-plans/renewals-and-cancellations/cancel-adobe-subscription.html",
        ["Sign in to your Adobe account plans page.", "Select Manage plan for the plan you want to cancel.", "Select Cancel your plan, continue through the reason and review screens, then confirm."],
        ["If you purchased through Apple, Google, or Microsoft, cancel through that provider.", "Adobe refund eligibility depends on the plan and when you cancel."],
    ),
    (
        "Canva", ["canva", "canva pro", "canva teams"], "https://www.canva.com/settings/billing", "https://www.canva.com/help/cancel-canva-plan/",
        ["Sign in to the Canva account and team that owns the paid plan.", "Open Settings, then Billing and plans.", "Find the active plan and choose Cancel plan or Manage subscription, then confirm."],
        ["Cancel through Apple App Store or Google Play if that is where the subscription was purchased.", "Deleting the Canva app does not cancel the subscription."],
    ),
    (
        "Microsoft 365", ["microsoft", "microsoft 365", "office365", "office 365", "onedrive"], "https://account.microsoft.com/services/microsoft365",
        "https://support.microsoft.com/en-us/accounts-billing/subscriptions/cancel-a-microsoft-365-subscription",
        ["Sign in at Microsoft services with the account used to buy Microsoft 365.", "Select Cancel subscription, Upgrade or Cancel, or turn off recurring billing.", "Review the cancellation page and choose the option that confirms you do not want the subscription."],
        ["If purchased from Apple, Google Play, Amazon, or another retailer, cancel through that seller.", "Microsoft warns that storage allowances may drop after cancellation."],
    ),
    (
        "YouTube Premium", ["youtube", "youtube premium", "youtube music", "google youtube"], "https://www.youtube.com/paid_memberships", "https://support.google.com/youtube/answer/6308278",
        ["Open youtube.com/paid_memberships while signed in.", "Click Manage membership, then Deactivate.", "Choose Continue to cancel, select a reason, then confirm with Yes, cancel."],
        ["If billed by Apple or Google Play, cancel through that subscription store.", "Benefits continue until the end of the billing period after cancellation."],
    ),
]
# What is told where no guide is known, and the notes on guides of the table.
FALLBACK_STEPS = [
    "Open the vendor's official account, billing, plan, or subscriptions page.",
    "Look for Manage plan, Billing, Subscriptions, Cancel, or Turn off recurring billing.",
    "Confirm cancellation and keep the confirmation email or screenshot.",
]
FALLBACK_HEAD = "Type: Web-search fallback\nUse when this provider is not in the local cancellation database."
FALLBACK_WATCH = "Verify the domain is the provider's official site before signing in."
FALLBACK_NOTE = "Use the web-search link to find current official cancellation instructions before entering credentials."
NO_CATEGORY_NOTE = "No known cancellation profile found yet."
TABLE_NOTES = ["Loaded from the subscription cancellation workbook.", "Verify current terms on the official site before acting."]
#: Sources in the order in which guides are listed.
SOURCES = ["xlsx_database", "built_in_database", "web_search"]


def provider_aliases(provider: Column) -> Column:
    """A provider's name, without what is in brackets, and its parts; longest first."""
    bare = F.trim(F.regexp_replace(provider, r"\s*\([^)]*\)", ""))
    parts = F.transform(F.split(provider, r"\s*/\s*|\s+-\s+|\s+\|\s+"), lambda x: F.trim(x))
    every = F.array_distinct(F.filter(F.concat(F.array(provider, bare), parts), lambda x: x != ""))
    return F.transform(F.array_sort(F.transform(every, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda s: s["x"])


def numbered(steps: list[str]) -> str:
    return "\n".join(f"{k}. {step}" for k, step in enumerate(steps, 1))


def built_in(spark) -> DataFrame:
    """The guides that come with the engine."""
    process = lambda name, url, steps, notes: f"Type: {name}\nDirect link: {url}\n\nWorkflow:\n{numbered(steps)}\n\nWatch-out:\n" + "\n".join(f"- {n}" for n in notes)
    rows = [(k, *g, process(g[0], g[2], *g[4:])) for k, g in enumerate(BUILT_IN)]
    df = spark.createDataFrame(rows, "ord int, service_name string, aliases array<string>, manage_url string, source_url string, steps array<string>, notes array<string>, cancellation_process string")
    none = F.lit("")
    return df.select(
        F.lit(1).alias("priority"), "ord", "service_name", "aliases", F.lit("built_in_database").alias("source"), "manage_url", "source_url", none.alias("category"), none.alias("market_position"),
        none.alias("price_range"), none.alias("billing_cycle"), F.col("manage_url").alias("website"), "cancellation_process", F.col("source_url").alias("additional_resources"), "steps", "notes",
    )


def from_table(rows: DataFrame, category: Column | None = None) -> DataFrame:
    """Guides of the eight-column table; rows without provider or process, comments, warnings and repeated headers are none."""
    cell = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[ \t]+\n", "\n"))
    provider, process = cell("Provider"), cell("Cancellation Process")
    df = rows.filter((provider != "") & (process != "") & ~F.lower(provider).isin("provider") & ~provider.rlike("^(#|Warning)"))
    manage = F.coalesce(F.nullif(text.first_url(process), F.lit("")), text.site_url(F.col("Website")))
    source = F.coalesce(F.nullif(text.first_url(F.col("additional resources")), F.lit("")), F.nullif(text.first_url(process), F.lit("")), manage)
    return df.select(
        F.lit(2).alias("priority"), F.coalesce("#", F.lit(0)).alias("ord"), provider.alias("service_name"), provider_aliases(provider).alias("aliases"), F.lit("xlsx_database").alias("source"),
        manage.alias("manage_url"), source.alias("source_url"), (category if category is not None else F.lit(SHEET)).alias("category"), cell("Market Position").alias("market_position"),
        cell("Price Range").alias("price_range"), cell("Billing Cycle").alias("billing_cycle"), cell("Website").alias("website"), process.alias("cancellation_process"),
        cell("additional resources").alias("additional_resources"), F.array().cast("array<string>").alias("steps"), F.array(*map(F.lit, TABLE_NOTES)).alias("notes"),
    )


def matches(names: DataFrame, guides: DataFrame) -> DataFrame:
    """``names(name)`` to every guide alias that they match, with the score.

    A match holds the other's text, or all its words; the guides go to the
    executors in blocks of bounded size, each to all names.
    """
    aliases = guides.select("*", F.posexplode("aliases").alias("place", "alias")).withColumn("plain", text.cleaned_any(F.col("alias")))
    distinct = names.select("name").distinct().withColumn("cleaned", text.cleaned_any(F.col("name")))
    blocks = max(1, -(-aliases.count() // FEW))
    block = F.pmod(F.xxhash64("priority", "ord", "place", "alias"), F.lit(blocks))
    joined = None
    for k in range(blocks):
        part = aliases.filter(block == k) if blocks > 1 else aliases
        found = distinct.join(F.broadcast(part), text.match_score(F.col("cleaned"), F.col("plain")) > 0)
        joined = found if joined is None else joined.union(found)
    return joined.withColumn("score", text.match_score(F.col("cleaned"), F.col("plain")))


def guide(names: DataFrame, guides: DataFrame) -> DataFrame:
    """``names(name, category)`` with their best guide: the highest score, then the table before the built-in ones, then the first; else a search."""
    best = Window.partitionBy("name").orderBy(F.col("score").desc(), F.col("priority").desc(), "ord", "place")
    found = matches(names, guides).withColumn("k", F.row_number().over(best)).filter("k = 1").drop("k", "cleaned", "plain", "place", "aliases", "ord", "priority").withColumnRenamed("category", "guide_category")
    df = names.join(found, "name", "left")
    name, none = F.trim(F.coalesce("name", F.lit(""))), F.col("score").isNull()
    label = F.when(name == "", "Unknown subscription").otherwise(text.titled(F.lower(name)))
    search = text.search_url(F.coalesce(F.nullif(name, F.lit("")), F.lit("subscription")))
    known = F.coalesce("category", F.lit(""))
    process = F.concat(F.lit(f"{FALLBACK_HEAD}\nWeb search: "), search, F.lit(f"\n\nWorkflow:\n{numbered(FALLBACK_STEPS)}\n\nWatch-out:\n{FALLBACK_WATCH}"))
    note = F.when(known != "", F.concat(F.lit("Detected category: "), known, F.lit("."))).otherwise(NO_CATEGORY_NOTE)
    either = lambda c, other: F.when(none, other).otherwise(F.col(c)).alias(c)
    return df.select(
        "name", either("service_name", label), F.coalesce("alias", name).alias("matched_name"), F.round(F.coalesce("score", F.lit(0.0)), 2).alias("confidence"), either("source", F.lit(SOURCES[-1])),
        either("manage_url", F.lit("")), either("source_url", F.lit("")), search.alias("search_url"), F.when(none, known).otherwise(F.col("guide_category")).alias("category"),
        *[either(c, F.lit("")) for c in ("market_position", "price_range", "billing_cycle", "website")], either("cancellation_process", process), either("additional_resources", search),
        either("steps", F.array(*map(F.lit, FALLBACK_STEPS))), either("notes", F.array(note, F.lit(FALLBACK_NOTE))),
    )


def listed(found: DataFrame) -> DataFrame:
    """One guide of each service, those of the table first, then by name."""
    place = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    one = Window.partitionBy("service_name").orderBy(place, F.col("confidence").desc(), "name")
    return found.withColumn("k", F.row_number().over(one)).filter("k = 1").drop("k").orderBy(place, "service_name")


def researched(answer: Column) -> Column:
    """A record out of an answer's JSON, also inside a fence or other words."""
    fields = "provider string, category string, market_position string, price_range string, billing_cycle string, website string, cancellation_process string, additional_resources string"
    return F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), fields)


def record_row(r: Column) -> tuple[Column, list[Column]]:
    """Whether a researched record is usable, and its table columns but the number."""
    plain = lambda c: F.trim(F.regexp_replace(F.coalesce(r[c], F.lit("")), r"[ \t]+\n", "\n"))
    position = F.coalesce(F.nullif(plain("market_position"), F.lit("")), F.lit("AI/web researched"))
    missing = (plain("category") != "") & ~F.lower(position).contains(F.lower(plain("category")))
    position = F.when(missing, F.concat(position, F.lit("\nCategory: "), plain("category"))).otherwise(position)
    known = lambda c: F.coalesce(F.nullif(plain(c), F.lit("")), F.lit("Unknown"))
    values = [plain("provider"), position, known("price_range"), known("billing_cycle"), plain("website"), plain("cancellation_process"), plain("additional_resources")]
    return (plain("provider") != "") & (plain("cancellation_process") != ""), [v.alias(c) for v, c in zip(values, COLUMNS[1:], strict=True)]


def research(names: DataFrame, table: DataFrame, fetch: Callable[[list[str]], list[str]]) -> DataFrame:
    """The table with what ``fetch`` (names to answers, called on the driver) finds on names that it has no guide for."""
    unknown = guide(names, from_table(table)).filter("source = 'web_search'").select("name").distinct()
    asked = [r.name for r in unknown.toLocalIterator()]
    answers = table.sparkSession.createDataFrame([(a,) for a in fetch(asked)], "answer string").select(researched(F.col("answer")).alias("r"))
    usable, columns = record_row(F.col("r"))
    return upserted(table, answers.filter(usable).select(*columns))
