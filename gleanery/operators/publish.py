"""Publishing: slugs, free note names, rendered notes, skills and renames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.durable import durable
from gleanery.functions.text import filled, iso_utc, json_scalar, quoted, strip
from gleanery.operators.ordered import HOT_ROWS, order_rows, running
from gleanery.policy import Policy

SLUG_LENGTH = 60
NUMBERED = r"\A(.*)-([2-9]|[1-9][0-9]{1,8})\z"
NUMBER_TAIL = r"((?:-(?:[2-9]|[1-9][0-9]{1,8}))*)\z"


def slug(title: Column) -> Column:
    dashed = F.btrim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), F.lit("-"))
    cut = F.rtrim(F.substring(dashed, 1, SLUG_LENGTH), F.lit("-"))
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("untitled"))


def slugify_titles(df: DataFrame, title: str = "title", out: str = "slug") -> DataFrame:
    return df.withColumn(out, slug(F.col(title)))


def file_name(slug_col: Column, number: Column) -> Column:
    numbered = F.concat(slug_col, F.lit("-"), number.cast("string"), F.lit(".md"))
    return F.when(number == 1, F.concat(slug_col, F.lit(".md"))).otherwise(numbered)


def assign_note_names(
    items: DataFrame, notes: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Rows (content_id, title, added_at, folder, slug, note_name): <slug>.md, or the first
    free of <slug>-2.md, <slug>-3.md, ...

    ``items`` is (content_id, title, added_at, folder); ``notes`` is (folder, note_name,
    owner) of the files already there. A file without owner counts as free. Names are handed
    out one after the other in this order: slugs with fewer number endings first (a numbered
    name can only clash with a slug that has one ending more); in a slug, items that own a
    file by its number, then new items by (added_at, content_id).
    """
    # The few columns that naming needs are written out: several passes read them.
    slugged = durable(
        slugify_titles(items.select("content_id", "title", "added_at", "folder")).withColumn(
            "_depth", F.size(F.split(F.regexp_extract("slug", NUMBER_TAIL, 1), "-")) - 1
        )
    )
    depths = sorted(r[0] for r in slugged.select("_depth").distinct().collect())
    owned = notes.filter("owner IS NOT NULL").select(
        "folder", F.regexp_replace("note_name", r"\.md\z", "").alias("_stem"), "owner"
    )
    taken = owned.select("folder", F.col("_stem").alias("slug"), F.lit(1).alias("number"), "owner")
    taken = taken.unionByName(
        owned.filter(F.col("_stem").rlike(NUMBERED)).select(
            "folder",
            F.regexp_extract("_stem", NUMBERED, 1).alias("slug"),
            F.regexp_extract("_stem", NUMBERED, 2).cast("int").alias("number"),
            "owner",
        )
    )
    wanted = slugged.select("folder", "slug").distinct()
    taken = durable(taken.join(wanted, ["folder", "slug"], "left_semi"))
    named, claimed = None, None
    for depth in depths:
        level = slugged.filter(F.col("_depth") == depth)
        occupied = taken if claimed is None else taken.unionByName(claimed)
        given = _number_items(level, occupied, hot_rows)
        if depth != depths[-1]:
            given = durable(given)
        claims = given.filter("number > 1").select(
            "folder",
            F.concat("slug", F.lit("-"), F.col("number").cast("string")).alias("slug"),
            F.lit(1).alias("number"),
            F.col("content_id").alias("owner"),
        )
        named = given if named is None else named.unionByName(given)
        claimed = claims
    if named is None:
        named = slugged.withColumn("number", F.lit(1))
    return named.withColumn("note_name", file_name(F.col("slug"), F.col("number"))).drop(
        "_depth", "number"
    )


def _number_items(level: DataFrame, occupied: DataFrame, hot_rows: int) -> DataFrame:
    """Add ``number`` for slugs whose names clash only with ``occupied``.

    Own files first: with t = free numbers below the file an item owns, an item in turn i
    takes a new number only while fewer than t are used up, so the count of used numbers is
    i + min(0, running min of (t_j - j)). The rest follow one by one. The r-th free number
    is r plus the taken numbers that have fewer than r free numbers below them.
    """
    place = ["folder", "slug"]
    wanted = level.select(*place).distinct()
    used = occupied.join(wanted, place, "left_semi").groupBy(*place, "number").agg(
        F.max("owner").alias("owner")
    )
    ranked = running(order_rows(used, place, ["number"], hot_rows), sums={"_j": F.lit(1)}).rows()
    used = durable(ranked.withColumn("_below", F.col("number") - F.col("_j")).drop("_j"))

    own = used.groupBy(*place, F.col("owner").alias("content_id")).agg(
        F.min(F.struct("number", "_below")).alias("_own")
    )
    joined = level.join(own, [*place, "content_id"], "left").withColumn(
        "_late", F.col("_own").isNull()
    )
    turn = ["_late", "_own", "added_at", "content_id"]
    rows = running(order_rows(joined, place, turn, hot_rows), sums={"_i": F.lit(1)})
    excess = F.col("_i") - F.col("_own._below")
    rows = running(rows, maxs={"_over": excess}, maxs_before={"_over_before": excess})

    def floored(name: str) -> Column:
        return F.greatest(F.col(name), F.lit(0))

    counted = rows.rows().withColumns(
        {
            "_used": F.col("_i") - floored("_over"),
            "_keeps": F.coalesce(excess > floored("_over_before"), F.lit(False)),
        }
    )

    # Walk items and taken numbers of a slug together to turn the r-th free into a number.
    item = F.struct(*(F.col(c) for c in level.columns))
    marks = used.select(
        *place,
        F.lit(None).cast(counted.select(item).schema[0].dataType).alias("_item"),
        (F.col("_below") * 2 + 1).alias("_pos"),
        F.lit(1).alias("_mark"),
        F.col("number").cast("string").alias("_tie"),
        F.lit(None).cast("int").alias("_kept"),
    )
    seekers = counted.select(
        *place,
        item.alias("_item"),
        (F.col("_used") * 2).alias("_pos"),
        F.lit(0).alias("_mark"),
        F.col("content_id").alias("_tie"),
        F.when(F.col("_keeps"), F.col("_own.number")).alias("_kept"),
    )
    both = order_rows(marks.unionByName(seekers), place, ["_pos", "_mark", "_tie"], hot_rows)
    walked = running(both, sums={"_passed": F.col("_mark")}).rows().filter("_mark = 0")
    number = F.coalesce(F.col("_kept"), (F.col("_pos") / 2 + F.col("_passed")).cast("int"))
    return walked.select("_item.*", number.alias("number"))


def render_notes(items: DataFrame) -> DataFrame:
    """Add ``content``: front matter (values as JSON, which YAML reads) and markdown body.

    ``items`` holds content_id, source_url, created_at, the enrichment fields and ``text``.
    """
    def front(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value)

    header = F.concat_ws(
        "\n",
        F.lit("---"),
        front("title", json_scalar(F.col("title"))),
        front("source_url", json_scalar(F.col("source_url"))),
        front("content_id", json_scalar(F.col("content_id"))),
        front("created_at", json_scalar(iso_utc(F.col("created_at")))),
        front("tags", F.to_json("tags")),
        front("tools_mentioned", F.to_json("tools_mentioned")),
        front("high_signal", F.col("high_signal").cast("string")),
        F.lit("---"),
    )

    def dashes(name: str, none: str) -> Column:
        lines = F.transform(name, lambda t: F.concat(F.lit("- "), t))
        return F.when(F.size(name) > 0, F.array_join(lines, "\n")).otherwise(none)

    skill = F.col("high_signal") & filled(F.col("skill_candidate_reason"))
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("# "), F.col("title")),
        F.lit("\n## Summary"),
        F.col("summary"),
        F.lit("\n## Key Takeaways"),
        dashes("key_takeaways", "- (none extracted)"),
        F.lit("\n## Tools Mentioned"),
        dashes("tools_mentioned", "- (none mentioned)"),
        F.when(skill, F.concat(F.lit("\n## Skill Candidate\n"), F.col("skill_candidate_reason"))),
        F.lit("\n## Transcript\n"),
        F.col("text"),
        F.lit(""),
    )
    return items.withColumn("content", F.concat(header, F.lit("\n\n"), body))


def skill_candidates(items: DataFrame, policy: Policy) -> DataFrame:
    """Items worth a skill, with ``skill_path``."""
    if not policy.skills_enabled:
        return items.filter(F.lit(False)).withColumn("skill_path", F.lit(None).cast("string"))
    worth = F.col("high_signal") & filled(F.col("skill_candidate_reason"))
    return items.filter(worth).withColumn(
        "skill_path", F.concat(slug(F.col("title")), F.lit("/SKILL.md"))
    )


def last_skill_per_path(skills: DataFrame) -> DataFrame:
    """Equal slugs overwrite each other: the latest (written_at, content_id) stays."""
    rest = [c for c in skills.columns if c != "skill_path"]
    last = F.max_by(F.struct(*rest), F.struct("written_at", "content_id")).alias("_last")
    kept = skills.groupBy("skill_path").agg(last).select("skill_path", "_last.*")
    return kept.withColumn("content", F.concat(strip(F.col("content")), F.lit("\n")))


def note_owner_check(state: DataFrame, notes: DataFrame) -> DataFrame:
    """Done rows whose note file exists, with the file's owner and title and ``owner_ok``.

    ``notes`` is (note_path, owner, title) as read from front matter. A file without owner
    is nobody else's.
    """
    done = state.filter((F.col("status") == "done") & filled(F.col("note_path")))
    files = notes.select("note_path", "owner", F.col("title").alias("file_title"))
    joined = done.join(files, "note_path")
    mine = F.col("owner").isNull() | (F.col("owner") == F.col("content_id"))
    return joined.withColumn("owner_ok", mine)


def organize_notes(state: DataFrame, notes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rename plan (content_id, note_path, new_path, change) that brings file names to titles.

    Files stay in their folder. All names present before the run count as taken, so the
    renames of a plan never meet and may run in any order. A file of another owner is
    reported and left alone.
    """
    checked = note_owner_check(state, notes)
    skipped = checked.filter("NOT owner_ok").select(
        "content_id",
        "note_path",
        F.lit(None).cast("string").alias("new_path"),
        F.concat(
            F.lit("skipped "),
            F.col("note_path"),
            F.lit(": frontmatter content_id "),
            quoted(F.col("owner")),
            F.lit(" != state record "),
            quoted(F.col("content_id")),
            F.lit(" (stale note_path)"),
        ).alias("change"),
    )
    folder = F.regexp_extract("note_path", r"\A(.*/)?[^/]*\z", 1)
    name = F.regexp_extract("note_path", r"([^/]*)\z", 1)
    stem = F.regexp_replace(name, r"\.[^.]*\z", "")
    title = F.when(filled(F.col("file_title")), F.col("file_title")).otherwise(stem)
    ours = checked.filter("owner_ok").select(
        "content_id", "note_path", title.alias("title"), "added_at", folder.alias("folder")
    )
    # A file that belongs to a state row is that row's own even without readable owner.
    holders = checked.filter("owner_ok").select("note_path", F.col("content_id").alias("holder"))
    present = notes.join(holders, "note_path", "left").select(
        folder.alias("folder"), name.alias("note_name"), F.coalesce("owner", "holder").alias("owner")
    )
    target = F.concat("folder", "note_name")
    paths = ours.select("content_id", "note_path")
    named = assign_note_names(ours, present, hot_rows).join(paths, "content_id")
    moved = named.filter(target != F.col("note_path"))
    moves = moved.select(
        "content_id",
        "note_path",
        target.alias("new_path"),
        F.concat(F.lit("moved "), F.col("note_path"), F.lit(" -> "), target).alias("change"),
    )
    return moves.unionByName(skipped)
