"""String, validation and formatting expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions.geo import col

#: Magic bytes of the accepted payloads.
TIFF_LITTLE, TIFF_BIG, PMTILES_MAGIC = "49492A00", "4D4D002A", "504D54696C6573"
#: Characters that XML reserves, in the order of replacement.
XML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))
PHASES = ("Pass1Nodes", "Pass2Ways", "Pass3Tiles", "Terrain", "Finalize", "Done")
#: Thermal state -> share of the budget, pause in ms (fixed policy).
THERMAL = (("nominal", 1.0, 0), ("fair", 1.0, 0), ("serious", 0.5, 25), ("critical", 0.0, 100))
TRANSIENT_ERRNOS = (28, 5)


def slug(label: Column | str) -> Column:
    """Lower case, runs of other characters as one dash, none at the ends; 'region' if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(col(label)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("region"))


def job_id(label: Column | str, millis: Column | str) -> Column:
    return F.concat(F.lit("bg_"), slug(label), F.lit("_"), F.lower(F.conv(col(millis).cast("string"), 10, 36)))


def xml_escape(s: Column | str) -> Column:
    out = col(s)
    for a, b in XML:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def elapsed(seconds: Column | str) -> Column:
    """HH:MM:SS, hours without limit."""
    s = col(seconds).cast("long")

    def two(v: Column) -> Column:
        t = v.cast("long").cast("string")
        return F.when(F.length(t) < 2, F.lpad(t, 2, "0")).otherwise(t)

    return F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s % 3600 / 60)), two(s % 60))


def bytes_label(n: Column | str) -> Column:
    n = col(n).cast("double")
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).when(n < 1048576, F.concat(F.round(n / 1024).cast("long").cast("string"), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", n / 1048576), F.lit(" MB")))


def metres_label(m: Column | str) -> Column:
    return F.concat(F.round(col(m)).cast("long").cast("string"), F.lit(" m"))


def delta_label(m: Column | str) -> Column:
    r = F.round(col(m)).cast("long")
    return F.concat(F.when(r > 0, F.lit("+")).otherwise(F.lit("")), r.cast("string"), F.lit(" m"))


def quota_summary(used: Column | str, quota: Column | str) -> Column:
    """Struct of GB used, GB allowed (a byte where unknown) and share, three decimals."""
    q = F.coalesce(F.nullif(col(quota).cast("double"), F.lit(0.0)), F.lit(1.0))
    gb = F.lit(float(1 << 30))
    return F.struct(F.round(col(used) / gb, 3).alias("used_gb"), F.round(q / gb, 3).alias("quota_gb"), F.round(col(used) / q, 3).alias("share"))


def progress_fraction(done: Column | str, total: Column | str) -> Column:
    return F.least(col(done).cast("double") / F.greatest(col(total).cast("double"), F.lit(1.0)), F.lit(1.0))


def phase_percent(phase: Column | str, fraction: Column | str, phases: int = 4) -> Column:
    """Percent of a job: whole phases before, and the fraction of the current one."""
    return F.least((col(phase) + F.least(F.greatest(col(fraction), F.lit(0.0)), F.lit(1.0))) / phases * 100, F.lit(100.0))


def resume_plan(local: Column | str, remote: Column | str) -> Column:
    """What a download does with a partial file: fresh, complete, or resume with the range that it asks for."""
    have, total = col(local), col(remote)
    return F.when(F.coalesce(have, F.lit(0)) == 0, "fresh").when(total.isNotNull() & (have == total), "complete").when(total.isNotNull() & (have > total), "fresh").otherwise(F.concat(F.lit("resume bytes="), have.cast("string"), F.lit("-")))


def bbox_error(text: Column | str) -> Column:
    """What is wrong with a box "west,south,east,north", or null."""
    parts = F.transform(F.split(col(text), ","), lambda x: F.trim(x))
    v = [F.try_element_at(parts, F.lit(i)).try_cast("double") for i in (1, 2, 3, 4)]
    w, s, e, n = v
    bad = F.lit(False)
    for x in v:
        bad = bad | x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return (
        F.when(col(text).isNull() | (F.size(parts) != 4), "arity")
        .when(bad, "number")
        .when((w < -180) | (w > 180) | (e < -180) | (e > 180) | (s < -90) | (s > 90) | (n < -90) | (n > 90), "range")
        .when((w >= e) | (s >= n), "inverted")
    )


def bbox_of(text: Column | str) -> Column:
    parts = F.transform(F.split(col(text), ","), lambda x: F.trim(x))
    names = ("west", "south", "east", "north")
    return F.when(bbox_error(text).isNull(), F.struct(*(F.try_element_at(parts, F.lit(i + 1)).try_cast("double").alias(k) for i, k in enumerate(names))))


def job_error(job: Column | str, min_zoom: Column | str, max_zoom: Column | str) -> Column:
    return F.when(~F.coalesce(col(job), F.lit("")).rlike("^[A-Za-z0-9_-]{1,128}$"), "job id").when(col(min_zoom) > col(max_zoom), "zoom order")


def payload_kind(content: Column | str) -> Column:
    """pbf, tiff, pmtiles or html by the first bytes; null for others."""
    c = col(content)
    head = F.hex(F.substring(c, 1, 8))
    start = F.lower(F.ltrim(F.decode(F.substring(c, 1, 32), "ISO-8859-1")))
    size = F.conv(F.substring(head, 1, 8), 16, 10).cast("long")
    pbf = (F.length(c) > 15) & (size > 0) & (size <= 65536) & F.contains(F.decode(F.substring(c, 5, 16), "ISO-8859-1"), F.lit("OSMHeader"))
    return F.when(start.startswith("<!doctype") | start.startswith("<html"), "html").when(F.substring(head, 1, 14) == PMTILES_MAGIC, "pmtiles").when(F.substring(head, 1, 8).isin(TIFF_LITTLE, TIFF_BIG), "tiff").when(pbf, "pbf")


def kind_of_path(path: Column | str) -> Column:
    p = F.lower(col(path))
    return F.when(p.endswith(".osm.pbf") | p.endswith(".pbf"), "pbf").when(p.endswith(".tif") | p.endswith(".tiff"), "tiff").when(p.endswith(".pmtiles"), "pmtiles")


def pkce_challenge(verifier: Column | str) -> Column:
    """URL-safe base64 of the SHA-256, without padding."""
    return F.translate(F.base64(F.unhex(F.sha2(col(verifier), 256))), "+/=", "-_")


def pkce_safe(binary: Column) -> Column:
    return F.translate(F.base64(binary), "+/=", "-_")


def layer_name(layer: Column | str) -> Column:
    from tarn.operators.mvt import LAYERS

    return F.try_element_at(F.array(*map(F.lit, LAYERS)), col(layer).cast("int") + 1)


def sac_colour(grade: Column | str) -> Column:
    """Line colour of a path by hiking grade (fixed values of the map style)."""
    g = col(grade)
    return F.when(g == "mountain_hiking", "#F1C40F").when(g == "demanding_mountain_hiking", "#E74C3C").when(g.isin("alpine_hiking", "demanding_alpine_hiking", "difficult_alpine_hiking"), "#000000").otherwise("#2ECC71")


def between_stops(at: Column | str, stops: list[tuple[float, float]]) -> Column:
    """Straight lines between stops, constant beyond them."""
    x = col(at).cast("double")
    out = F.when(x <= stops[0][0], F.lit(float(stops[0][1])))
    for (a, u), (b, v) in zip(stops, stops[1:], strict=False):
        out = out.when(x <= b, F.lit(float(u)) + (x - a) / (b - a) * (v - u))
    return out.otherwise(F.lit(float(stops[-1][1])))


def halo_radius(accuracy: Column | str, lat: Column | str, zoom: Column | str, at_zoom: float = 20.0) -> Column:
    """Pixels of an accuracy circle: true at a high zoom, halved with each zoom below it."""
    return col(accuracy) * F.cos(F.radians(col(lat))) / 0.075 * F.pow(F.lit(2.0), col(zoom) - at_zoom)


def chart_index(x: Column | str, width: Column | str, n: Column | str) -> Column:
    f = F.least(F.greatest(F.try_divide(col(x), col(width)), F.lit(0.0)), F.lit(1.0))
    return F.round(f * (col(n) - 1)).cast("long")


def with_licence(text: Column | str, header: str) -> Column:
    """The header line before a text, unless one of its first three lines has it."""
    head = F.slice(F.split(col(text), "\n"), 1, 3)
    return F.when(F.exists(head, lambda x: F.contains(x, F.lit(header))), col(text)).otherwise(F.concat(F.lit(header + "\n"), col(text)))


def thermal(state: Column | str, what: int) -> Column:
    """Budget share (1) or pause (2) of a thermal state."""
    out = None
    for row in THERMAL:
        test = F.lower(col(state)) == row[0]
        out = F.when(test, F.lit(row[what])) if out is None else out.when(test, F.lit(row[what]))
    return out


def android_thermal(status: Column | str) -> Column:
    """Thermal state of a platform's status number."""
    s = col(status)
    return F.when(s <= 1, "nominal").when(s == 2, "fair").when(s == 3, "serious").otherwise("critical")


def fnv1a(content: Column | str) -> Column:
    """64-bit FNV-1a of bytes as hex.

    The product is cut to 64 bits in two halves, so nothing overflows: with h = hi * 2^32 + lo, the prime
    2^40 + 435 gives lo * 435 for the low half and its carry, and hi * 435 + lo * 2^8 for the high half.
    """
    c = F.hex(col(content).cast("binary"))
    n = (F.length(c) / 2).cast("int")
    low32 = F.lit(0xFFFFFFFF).cast("long")

    def step(s: Column, i: Column) -> Column:
        byte = F.conv(F.substring(c, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
        lo = s["lo"].bitwiseXOR(byte)
        p = lo * 435
        hi = (s["hi"] * 435 + F.shiftleft(lo, 8) + F.shiftrightunsigned(p, 32)).bitwiseAND(low32)
        return F.struct(hi.alias("hi"), p.bitwiseAND(low32).alias("lo"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    end = F.aggregate(steps, start, step)
    return F.lower(F.concat(F.lpad(F.hex(end["hi"]), 8, "0"), F.lpad(F.hex(end["lo"]), 8, "0")))
