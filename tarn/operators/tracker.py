"""Source-text analytics: tags in comments, their conflicts, and rules about forbidden patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that are scanned, and the grammar of the tags.
EXTENSIONS = ("rs", "swift", "kt", "ts", "tsx", "js", "mjs", "sh", "py", "toml", "yml", "yaml", "gradle", "lock")
PLATFORMS = {"ios": "ios/", "android": "android/", "web": "src/", "core": "core/"}
SEVERITIES = ("blocker", "major", "minor")
_SEP, _MARK = r"\s+(?:—|--)\s+", r"(?://|#)"
HINT = rf"{_MARK}.*\b(DEBT|BUG|RULE-EXEMPT)\("
DEBT = rf"{_MARK}\s*DEBT\((D\d{{3,}})\):\s*(.+?){_SEP}platforms:\s*([a-z, ]+)\s*$"
BUG = rf"{_MARK}\s*BUG\((B\d{{3,}})\):\s*(.+?){_SEP}severity:\s*(\w+){_SEP}repro:\s*(.+)\s*$"
EXEMPT = rf"{_MARK}\s*RULE-EXEMPT\(([PR]\d+[a-z]?)\):\s*(\S.*)\s*$"


def source_tree(spark: SparkSession, root: str, ignore: tuple[str, ...] = (".git/", "node_modules/", "dist/", "docs/")) -> DataFrame:
    """path (below root), line, text of files with a scanned extension, those under ignored prefixes left out."""
    base = root.rstrip("/")
    files = spark.read.text(base, wholetext=True, recursiveFileLookup=True).select(F.regexp_replace(F.input_file_name(), rf"^.*?{base}/", "").alias("path"), "value")
    kept = files.where(F.element_at(F.split("path", r"\."), -1).isin(*EXTENSIONS))
    for prefix in ignore:
        kept = kept.where(~F.col("path").startswith(prefix))
    return kept.select("path", F.posexplode(F.split("value", "\n")).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("line"), "text")


def tags(lines: DataFrame, platforms: dict[str, str] | None = None) -> DataFrame:
    """path, line, kind (debt, bug, exempt, malformed), id, description, detail (platforms or severity), repro, error."""
    known = F.array(*(F.lit(p) for p in (platforms or PLATFORMS)))
    hinted = lines.where(F.col("text").rlike(HINT))
    kind = F.when(F.col("text").rlike(DEBT), "debt").when(F.col("text").rlike(BUG), "bug").when(F.col("text").rlike(EXEMPT), "exempt").otherwise("malformed")

    def part(i: int):
        return F.when(F.col("kind") == "debt", F.regexp_extract("text", DEBT, i)).when(F.col("kind") == "bug", F.regexp_extract("text", BUG, i)) if i > 2 else F.when(F.col("kind") == "debt", F.regexp_extract("text", DEBT, i)).when(F.col("kind") == "bug", F.regexp_extract("text", BUG, i)).when(F.col("kind") == "exempt", F.regexp_extract("text", EXEMPT, i))

    parsed = hinted.withColumn("kind", kind).select("path", "line", "kind", part(1).alias("id"), F.trim(part(2)).alias("description"), part(3).alias("detail"), F.when(F.col("kind") == "bug", F.trim(F.regexp_extract("text", BUG, 4))).alias("repro"))
    listed = F.filter(F.transform(F.split("detail", ","), lambda x: F.trim(x)), lambda p: p != "")
    detail = F.when(F.col("kind") == "debt", F.array_join(listed, ",")).otherwise(F.col("detail"))
    bad_platforms = (F.col("kind") == "debt") & ((F.size(listed) == 0) | (F.size(F.array_except(listed, known)) > 0))
    error = F.when(F.col("kind") == "malformed", "malformed tag").when(bad_platforms, "invalid platforms").when((F.col("kind") == "bug") & ~F.col("detail").isin(*SEVERITIES), "invalid severity")
    return parsed.withColumn("error", error).withColumn("detail", detail)


def _valid(found: DataFrame) -> DataFrame:
    return found.where("error is null and kind in ('debt', 'bug')")


def inventory(found: DataFrame) -> DataFrame:
    """kind, id, description, detail, sites and conflicts: how many sites agree with the first, by path and line, and how many do not.

    Sites are counted by what they say before they meet by id, so an id that most lines carry is a row a task and text.
    """
    said = _valid(found).groupBy("kind", "id", "description", "detail").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "line")).alias("at"))
    ids = said.groupBy("kind", "id").agg(F.min_by(F.struct("description", "detail", "n"), "at").alias("f"), F.sum("n").alias("n"))
    return ids.select("kind", "id", "f.description", "f.detail", F.col("f.n").alias("sites"), (F.col("n") - F.col("f.n")).alias("conflicts"))


def sites(found: DataFrame) -> DataFrame:
    """kind, id, description, detail, site ("path:line"): a row for each site that agrees with the first of its id."""
    first = inventory(found).select("kind", "id", "description", "detail")
    return _valid(found).join(first, ["kind", "id", "description", "detail"]).select("kind", "id", "description", "detail", F.concat_ws(":", "path", F.col("line").cast("string")).alias("site"))


def missing_mirrors(found: DataFrame, platforms: dict[str, str] | None = None) -> DataFrame:
    """id, platform: declared platforms of debts that have no site in the platform's tree."""
    trees = platforms or PLATFORMS
    debts = found.where("error is null and kind = 'debt'")
    declared = debts.select("id", F.explode(F.split("detail", ",")).alias("platform")).distinct()
    tree = F.create_map(*(F.lit(x) for kv in trees.items() for x in kv))
    sites = debts.select("id", F.explode(F.map_entries(tree)).alias("t"), "path").where(F.col("path").startswith(F.col("t.value"))).select("id", F.col("t.key").alias("platform")).distinct()
    return declared.join(sites, ["id", "platform"], "left_anti")


def glob_regex(glob: str) -> str:
    """Two stars cross directories, one stays within."""
    import re

    return "^" + "".join(".*" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in re.split(r"(\*\*|\*)", glob)) + "$"


def violations(lines: DataFrame, rules: list[tuple[str, str, list[str]]], found: DataFrame | None = None) -> DataFrame:
    """rule, path, line where a rule's pattern occurs in its paths and no exemption of that rule stands on the line or the one before.

    Rules (id, regex, globs) are few and given by the caller, so each line is tested against an array of them in place
    of a join; exemptions cover two lines each and are taken out by an anti-join.
    """
    hits = F.array(*(F.when(F.col("text").rlike(pattern) & F.col("path").rlike("|".join(map(glob_regex, globs))), F.lit(rule)) for rule, pattern, globs in rules))
    raw = lines.where(~F.col("text").rlike(EXEMPT)).select("path", "line", F.explode(F.filter(hits, lambda r: r.isNotNull())).alias("rule"))
    exempt = (found if found is not None else tags(lines)).where("kind = 'exempt'").select(F.col("id").alias("rule"), "path", F.explode(F.array(F.col("line"), F.col("line") + 1)).alias("line")).distinct()
    return raw.join(exempt, ["rule", "path", "line"], "left_anti").select("rule", "path", "line")


def unburied(tracked: DataFrame, live: DataFrame, buried: DataFrame) -> DataFrame:
    """Ids once tracked that are neither live nor buried."""
    return tracked.select("id").distinct().join(live.select("id"), "id", "left_anti").join(buried.select("id"), "id", "left_anti")


def report(found: DataFrame) -> DataFrame:
    """One row: the tracker page, debts and bugs sorted by id with their sites.

    A page is a text of one row, so it suits as many sites as a reader can look through; `sites` gives them as rows.
    """
    listed = sites(found).groupBy("kind", "id", "description", "detail").agg(F.array_sort(F.collect_list("site")).alias("sites"))
    rows = listed.select("kind", "id", F.concat(F.lit("- "), "id", F.lit(" "), "description", F.lit(" ["), "detail", F.lit("] "), F.array_join("sites", ", ")).alias("text"))
    kinds = rows.groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda r: r["text"]), "\n").alias("body"), F.count(F.lit(1)).alias("n"))
    return kinds.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.when(F.col("kind") == "debt", 0).otherwise(1).alias("o"), F.concat(F.lit("## "), "kind", F.lit("\n"), "body").alias("t")))), lambda r: r["t"]), "\n\n").alias("page"))


def rules_of(text: str) -> list[tuple[str, str, list[str]]]:
    """Rules from a page with lines rule-id:, forbidden-pattern: and paths:."""
    out: list[tuple[str, str, list[str]]] = []
    for raw in text.split("\n"):
        key, _, value = raw.strip().partition(":")
        value = value.strip()
        if key == "rule-id":
            out.append((value, "", []))
        elif key == "forbidden-pattern" and out:
            out[-1] = (out[-1][0], value.strip("`"), out[-1][2])
        elif key == "paths" and out:
            out[-1] = (*out[-1][:2], [p.strip() for p in value.split(",") if p.strip()])
    return [r for r in out if r[1]]
