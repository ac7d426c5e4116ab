"""String, parsing and naming functions on columns; all of them stay in the JVM."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_name(name: Column) -> Column:
    """A video's name: trimmed, without folders (either slash) and without a final .mp4 in any case. Null stays null."""
    trimmed = F.regexp_replace(name, r"(?U)^\s+|\s+$", "")
    base = F.regexp_extract(trimmed, r"(?s)([^/\\]*)$", 1)
    return F.regexp_replace(base, r"(?i)\.mp4$", "")


def stem(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def splitext(path: Column) -> Column:
    """A path without its extension; a dot that opens a name is none."""
    return F.regexp_replace(path, r"(?s)([^/.])\.[^/.]*\z", "$1")


def range_list(text: Column, separator: str) -> Column:
    """``array<struct<s, e>>`` of 'a-b' tokens between separators; other tokens are skipped, reversed ranges are empty.

    A token is two whole numbers joined by one hyphen, with blanks or a plus sign
    allowed. Null, blank and '0' give the empty array.
    """
    token = r"^\s*\+?[0-9]{1,9}\s*-\s*\+?[0-9]{1,9}\s*$"
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), separator), lambda t: t.rlike(token))
    number = lambda t, i: F.regexp_extract(t, r"([0-9]+)[^0-9]+([0-9]+)", i).cast("int")
    pairs = F.transform(tokens, lambda t: F.struct(number(t, 1).alias("s"), number(t, 2).alias("e")))
    return F.filter(pairs, lambda p: p["s"] <= p["e"])


def any_range_list(text: Column) -> Column:
    """``range_list`` of a text in which commas count as semicolons."""
    return range_list(F.replace(text, F.lit(","), F.lit(";")), ";")


def parse_ranges(text: Column, dialect: str) -> Column:
    """``range_list`` by the separator of the dialect: commas for "UBnormal", else semicolons."""
    return range_list(text, "," if dialect == "UBnormal" else ";")


def merged_ranges(ranges: Column, universe: Column | None = None) -> Column:
    """Disjoint, not even adjacent ranges of the same frames, in order; with ``universe`` only frames from 0 to before it. No frame is made."""
    if universe is not None:
        ranges = F.filter(F.transform(ranges, lambda r: F.struct(r["s"].alias("s"), F.least(r["e"], (universe - 1).cast("int")).alias("e"))), lambda r: r["s"] <= r["e"])
    kind = "array<struct<s: int, e: int>>"

    def add(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["s"].alias("s"), F.greatest(last["e"], r["e"]).alias("e"))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))
        return F.when(F.size(done) == 0, F.array(r)).when(last["e"] >= r["s"] - 1, joined).otherwise(F.concat(done, F.array(r))).cast(kind)

    return F.aggregate(F.sort_array(ranges.cast(kind)), F.array().cast(kind), add)


def covered_frames(merged: Column) -> Column:
    """How many frames disjoint ranges hold."""
    return F.aggregate(merged, F.lit(0).cast("long"), lambda n, r: n + r["e"] - r["s"] + 1)


def frame_list(ranges: Column, universe: Column) -> Column:
    """The distinct frames of an array of ranges below ``universe``, sorted; what a range names beyond it is never made."""
    return F.flatten(F.transform(merged_ranges(ranges, universe), lambda r: F.sequence(r["s"], r["e"])))


def range_text(ranges: Column, separator: str = "; ") -> Column:
    """'s-e' texts of an array of ranges, joined in order."""
    return F.array_join(F.transform(ranges, lambda r: F.concat_ws("-", r["s"], r["e"])), separator)


def frame_name(base: Column, clip: Column, frame: Column) -> Column:
    """'{base}_clip{clip:04d}_{frame:02d}.jpg'; wider numbers widen the name."""
    return F.concat(base, F.lit("_clip"), _padded(clip, 4), F.lit("_"), _padded(frame, 2), F.lit(".jpg"))


def _padded(number: Column, width: int) -> Column:
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def image_name(label: Column, counter: Column) -> Column:
    """'{label}_{counter:04d}'; wider numbers widen the name."""
    return F.concat(label, F.lit("_"), _padded(counter, 4))


def image_path(label: Column, branch: Column, name: Column) -> Column:
    """'{label}/{branch}/{name}.jpg'."""
    return F.concat(F.concat_ws("/", label, branch, name), F.lit(".jpg"))


def filled(template: str, **values: Column) -> Column:
    """A template whose {name} and {name:02d} fields hold the columns; a null value makes the text null."""
    parts = []
    for text, name, spec, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            width = int(spec[1:-1]) if spec else 0
            parts.append(_padded(values[name], width) if width else values[name].cast("string"))
    return F.concat(*parts)


def parse_frame_name(name: Column) -> Column:
    """struct(video, clip, frame) of a frame's file name; null if it is none. The last '_clip' counts."""
    pattern = r"^(.*)_clip([0-9]{1,9})_([0-9]{1,9})$"
    own = F.regexp_replace(name, r"\.[^.]*$", "")
    part = lambda i: F.regexp_extract(own, pattern, i)
    return F.when(own.rlike(pattern), F.struct(part(1).alias("video"), part(2).cast("int").alias("clip"), part(3).cast("int").alias("frame")))


def scene_path(name: Column) -> Column:
    """'Scene{third part of the name}/{name}.mp4'; null where the name has fewer parts."""
    return F.concat(F.lit("Scene"), F.get(F.split(name, "_"), F.lit(2)), F.lit("/"), name, F.lit(".mp4"))


def is_timeout(message: Column) -> Column:
    """Whether a message has the timeout prefix."""
    return F.startswith(message, F.lit("TIMEOUT:"))


def classify_error(message: Column) -> Column:
    """The message, with the timeout prefix if it speaks of one."""
    return F.when(F.lower(message).rlike("timeout|timed out"), F.concat(F.lit("TIMEOUT: "), message)).otherwise(message)


def clean_answer(text: Column) -> Column:
    """The JSON array in a model's answer: thoughts removed, then the first '[' to the last ']'; null without one."""
    bare = F.regexp_replace(text, r"(?s)<Think>.*?</Think>", "")
    got = F.regexp_extract(bare, r"(?s)\[.*\]", 0)
    return F.when(got != "", got)


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing more; null for null.

    The parser stops after the first value. What follows one inside brackets makes
    an array longer or an object's member unnamed, so no such text passes both.
    """
    listed, held = F.concat(F.lit("["), text, F.lit("]")), F.concat(F.lit('{"x":'), text, F.lit("}"))
    return F.when(text.isNotNull(), F.try_parse_json(listed).isNotNull() & F.try_parse_json(held).isNotNull())


def format_time(seconds: Column) -> Column:
    """'5s', '1m05s' or '2h03m'; fractions of a second are cut."""
    s = F.floor(seconds)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    minutes, hours = F.floor(s / 60), F.floor(s / 3600)
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(minutes.cast("string"), F.lit("m"), two(F.pmod(s, F.lit(60))), F.lit("s"))).otherwise(F.concat(hours.cast("string"), F.lit("h"), two(F.pmod(minutes, F.lit(60))), F.lit("m")))


def progress_bar(done: Column, total: Column, width: int = 20) -> Column:
    """'#' for each whole share done, '-' for the rest."""
    full = F.floor(width * done / total).cast("int")
    return F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("-"), F.lit(width) - full))


def eta(elapsed: Column, done: Column, total: Column) -> Column:
    """The time left at the pace so far, as ``format_time`` writes it; '???' before anything is done."""
    return F.when(done > 0, format_time(elapsed / done * (total - done))).otherwise("???")


def percent(done: Column, total: Column) -> Column:
    """The share done, 0 where there is nothing to do."""
    return F.when(total > 0, done / total).otherwise(0.0)


def context_text(parts: dict[str, Column], plain: Column) -> Column:
    """The scene context: the plain text, or '{time} {location}, {detail}' without hanging commas and blanks."""
    made = F.concat(F.coalesce(parts["time"], F.lit("")), F.lit(" "), F.coalesce(parts["location"], F.lit("")), F.lit(", "), F.coalesce(parts["detail"], F.lit("")))
    return F.coalesce(plain, F.regexp_replace(made, r"^[, ]+|[, ]+$", ""))


def branch_info(types: Column, labels: Column) -> Column:
    """'type:label' pairs joined by commas."""
    return F.array_join(F.zip_with(types, labels, lambda t, lab: F.concat_ws(":", t, lab)), ",")


def branch_labels(info: Column) -> Column:
    """array<struct(pos, label)>: 0 for Normal, else 1; parts without a colon keep their position but give nothing."""
    parts = F.transform(F.split(info, ","), lambda p, i: F.struct(i.alias("pos"), F.get(F.split(p, ":"), F.lit(1)).alias("name")))
    kept = F.filter(parts, lambda p: p["name"].isNotNull())
    return F.transform(kept, lambda p: F.struct(p["pos"].alias("pos"), F.when(p["name"] == "Normal", 0).otherwise(1).alias("label")))


def branch_type(key: Column) -> Column:
    """1 for a key that says abnormal, else 0."""
    return F.contains(key, F.lit("abnormal")).cast("int")


def grid_boxes(width: Column, height: Column, rows: int, cols: int) -> Column:
    """array of boxes (r, c, x0, y0, x1, y1), row by row; pixels that do not divide are dropped."""
    w, h = F.floor(width / cols).cast("int"), F.floor(height / rows).cast("int")
    return F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), (w * c).alias("x0"), (h * r).alias("y0"), (w * (c + 1)).alias("x1"), (h * (r + 1)).alias("y1")) for r in range(rows) for c in range(cols)])


def resized(width: Column, height: Column, target_w: Column, target_h: Column) -> Column:
    """struct(w, h): target size, keeping the aspect where one side is not given, unchanged where none is."""
    w = F.when(target_w > 0, target_w).when(target_h > 0, F.floor(width * target_h / height)).otherwise(width)
    h = F.when(target_h > 0, target_h).when(target_w > 0, F.floor(height * target_w / width)).otherwise(height)
    return F.struct(w.cast("int").alias("w"), h.cast("int").alias("h"))
