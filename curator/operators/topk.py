"""Top-N lists, stable and rotating pages, interleaving and selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curator.functions.paths import file_name, parts, preference_key, stem, suffix
from curator.operators.ordered import ordered_scan
from curator.runtime import materialize


def top_n(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The first n rows of a total order, numbered; n is the report size."""
    best = df.orderBy(*order).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def page(df: DataFrame, order: Sequence[Column | str], offset: int, limit: int) -> DataFrame:
    """One page of a stable total order with the total and the next offset.

    The page is cut by Spark's ordered limit; only its `limit` rows are numbered.
    """
    shown = df.orderBy(*order).offset(offset).limit(limit)
    place = F.row_number().over(Window.orderBy(*order)).cast("long") + offset
    more = F.col("total") > offset + limit
    return shown.withColumn("position", place).withColumn("total", df.agg(F.count(F.lit(1))).scalar()).withColumn(
        "next_offset", F.when(more, F.lit(offset + limit).cast("long"))
    ).withColumn("truncated", more)


def rotating_page(df: DataFrame, key: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """A page whose start depends on the key, so that issues look at different rows.

    `key` columns name the issue (and group the rows); the start is a hash of
    the key modulo the number of rows, 0 when everything fits.
    """
    placed = ordered_scan(df, order, key, position="_place", size="total")
    text = F.concat(F.lit('["'), F.array_join(F.array(*[F.col(k).cast("string") for k in key]), '","'), F.lit('"]'))
    start = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % F.col("total")
    turned = placed.withColumn("offset", F.when(F.col("total") > limit, start).otherwise(F.lit(0).cast("long"))).withColumn(
        "position", F.pmod(F.col("_place") - 1 - F.col("offset"), F.col("total")) + 1
    )
    return turned.where(F.col("position") <= limit).drop("_place")


def round_robin(df: DataFrame, limit: int) -> DataFrame:
    """Interleave sources fairly; at most `limit` identities that are new.

    df: source, place (sortable inside the source), identity, is_known. Known
    identities are free; a repeated identity keeps its first place and lists all
    of its sources.
    """
    turns = ordered_scan(df, ["place"], ["source"], position="turn")
    first = turns.groupBy("identity").agg(
        F.min(F.struct("turn", "source", "is_known")).alias("f"),
        # One entry per configured source at most.
        F.array_sort(F.collect_set("source")).alias("sources"),
    ).select("identity", "f.turn", "f.source", "f.is_known", "sources")
    # The second scan reads its input several times: keep the first one's result.
    first = materialize(first, "round-robin")
    counted = ordered_scan(first, ["turn", "source", "identity"], sums={"new_so_far": (~F.col("is_known")).cast("long")})
    return counted.where(F.col("is_known") | (F.col("new_so_far") <= limit))


def select_issue(accepted: DataFrame, maximum: int, featured: int = 3) -> DataFrame:
    """The items of one issue: best first, one per original event, some featured.

    accepted: candidate_id, total, event_url (null = no event), kind, ...
    """
    rest = [c for c in accepted.columns if c != "event_url"]
    with_event = accepted.where("event_url is not null").groupBy("event_url").agg(
        F.min(F.struct((-F.col("total")).alias("_o"), F.col("candidate_id").alias("_c"), *rest)).alias("b")
    ).select(*[F.col(f"b.{c}").alias(c) for c in rest], "event_url")
    kept = with_event.unionByName(accepted.where("event_url is null"))
    issue = top_n(kept, maximum, [F.col("total").desc(), F.col("candidate_id").asc()])
    # At most `maximum` rows are left: one small window.
    nth = F.sum(F.when(F.col("kind") != "reading", 1).otherwise(0)).over(Window.orderBy("rank"))
    return issue.withColumn("featured", (F.col("kind") != "reading") & (nth <= featured))


# The order in which questions are answered.
QUESTION_ORDER = ("license", "installation", "usage")


def choose_documents(files: DataFrame, n: int, repo: str = "repository", profile: str = "basic") -> DataFrame:
    """Up to n documents per repository: one per question, then by preference.

    files: repository, file_path, question. The discovery profile goes by
    preference alone.
    """
    key = preference_key("file_path", F.col("question"), profile)
    keyed = files.withColumn("_p", key)
    if profile == "basic":
        firsts = keyed.groupBy(repo, "question").agg(F.min("_p").alias("_first"))
        turn = F.array_position(F.array(*[F.lit(q) for q in QUESTION_ORDER]), F.col("question"))
        keyed = keyed.join(firsts, [repo, "question"]).withColumn(
            "_turn", F.when((F.col("_p") == F.col("_first")) & (turn > 0), turn).otherwise(F.lit(len(QUESTION_ORDER) + 1))
        )
    else:
        keyed = keyed.withColumn("_turn", F.lit(1))
    order = ["_turn", *[F.col(f"_p.{f}") for f in "abcde"]]
    placed = ordered_scan(keyed, order, [repo], position="place")
    return placed.where(F.col("place") <= n).drop("_p", "_first", "_turn")


# Source suffixes, excluded folders, entry points and focus names.
_SOURCE_SUFFIXES = (".py", ".ts", ".tsx", ".js", ".go", ".rs", ".java", ".c", ".cpp")
_SKIPPED_FOLDERS = ("tests", "test", "vendor", "dist", "fixtures", "examples")
_ENTRY_STEMS = ("main", "index", "app", "cli", "core", "run")
_FOCUS_NAMES = (
    "agents.md", "context.md", "pyproject.toml", "package.json", "cargo.toml", "go.mod", "requirements.txt",
)
_FOCUS_BYTES = 2 * 1024 * 1024


def choose_files(paths: DataFrame, n: int = 6, repo: str = "repository") -> DataFrame:
    """Source files worth reading first: entry points, main folders, shallow."""
    p = F.col("path")
    usable = (
        suffix(p).isin(*_SOURCE_SUFFIXES) & ~p.startswith("/")
        & ~F.exists(parts(p), lambda x: x.startswith(".") | x.isin(*_SKIPPED_FOLDERS))
        & ~p.rlike(r"\.(?:test|spec|d)\.ts$")
    )
    order = [
        (~stem(p).isin(*_ENTRY_STEMS)).cast("int"),
        (~F.get(parts(p), 0).isin("src", "lib")).cast("int"),
        F.size(parts(p)), p,
    ]
    return ordered_scan(paths.where(usable), order, [repo], position="place").where(F.col("place") <= n)


def focus_files(files: DataFrame, n: int = 100, repo: str = "repository") -> DataFrame:
    """Project files shown as context: guides and manifests first, no large file."""
    lowered = F.lower(F.replace(F.col("path"), F.lit("\\"), F.lit("/")))
    name = file_name(lowered)
    preferred = name.startswith("readme") | name.startswith("todo") | name.isin(*_FOCUS_NAMES) | lowered.startswith("docs/adr/")
    small = files.where(F.col("size") <= _FOCUS_BYTES)
    return ordered_scan(small, [(~preferred).cast("int"), lowered, F.col("path")], [repo], position="place").where(F.col("place") <= n)


def ranked_groups(df: DataFrame) -> DataFrame:
    """Each reviewed candidate's group and its place in the group.

    df: eligibility, decision (null = unreviewed), total, canonical_url,
    candidate_id. Publication blocks come before every editorial decision.
    """
    group = (
        F.when(F.col("eligibility") == "blocked", F.lit("blocked"))
        .when(F.col("decision").isNull(), F.lit("unreviewed"))
        .when(F.col("eligibility") == "needs_evidence", F.lit("needs_evidence"))
        .when(F.col("decision") == "defer", F.lit("deferred"))
        .when(F.col("decision") == "reject", F.lit("rejected"))
        .otherwise("available")
    )
    score = -F.coalesce(F.col("total"), F.lit(0))
    return ordered_scan(
        df.withColumn("group", group), [score, F.col("canonical_url"), F.col("candidate_id")], ["group"], position="place"
    )


def oldest_pending(drafts: DataFrame, period: str, target: int = 20) -> DataFrame:
    """The draft with the oldest period and how many items it still lacks."""
    rest = [c for c in drafts.columns if c != period]
    return drafts.agg(F.min(F.struct(period, *rest)).alias("o")).where("o is not null").select(
        "o.*", F.greatest(F.lit(0), F.lit(target) - F.col("o.item_count")).alias("shortfall")
    )
