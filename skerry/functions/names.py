"""Paths and names as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as scripting languages trim it: the characters, and a class for regular expressions.
BLANKS = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"

# Extensions.
TEXT_EXTENSIONS = ("md", "txt", "note", "clip", "json", "xml", "html", "htm", "css", "js", "ts", "py", "sh", "yaml", "yml", "toml", "ini", "cfg", "csv", "log", "rst", "tex", "bib", "org")
COMPARABLE_EXTENSIONS = ("md", "txt", "html", "htm", "xml", "json", "css", "js", "csv")
MARKDOWN_EXTENSIONS = ("md", "txt")
ASSET_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "webp", "bmp", "svg", "pdf", "mp3", "m4a", "wav", "mp4", "zip")
# Media types by extension.
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "pdf": "application/pdf", "mp3": "audio/mpeg", "mp4": "video/mp4", "md": "text/markdown", "txt": "text/plain", "json": "application/json"}


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim(x: Column) -> Column:
    return F.trim(x, F.lit(BLANKS))


def basename(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def dirname(path: Column | str) -> Column:
    """The directory, '' at the root."""
    return F.regexp_extract(col(path), r"^(.*)/[^/]*$", 1)


def extension(path: Column | str) -> Column:
    """Lower-cased extension without the dot, '' if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"[^.]\.([^.]+)$", 1))


def stem(path: Column | str) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def join_path(base: Column | str, name: Column | str) -> Column:
    return F.concat_ws("/", F.nullif(col(base), F.lit("")), col(name))


def normalize_separators(path: Column | str) -> Column:
    return F.replace(col(path), F.lit("\\"), F.lit("/"))


def sanitize(name: Column | str) -> Column:
    """A name that any file system takes; '' if nothing is left."""
    out = F.replace(col(name), F.lit("<"), F.lit("_"))
    out = F.regexp_replace(out, r'[\\/":|*?#>\n\r]', "")
    out = F.regexp_replace(trim(out), f"{SPACE}+", " ")
    return F.regexp_replace(out, r"(?<=[^ ]) +(?=\.[^.]*$)", "")


def map_remote_name(name: Column | str) -> Column:
    """Sanitised; note kinds and names without an extension become Markdown."""
    out = sanitize(name)
    has = out.rlike(r"^.+\.[^.]*$")
    return F.when(out.rlike(r"^.+\.(note|clip)$"), F.regexp_replace(out, r"\.[^.]*$", ".md")).when(has, out).otherwise(F.concat(out, F.lit(".md")))


def official_name(name: Column | str) -> Column:
    return F.when(F.lower(col(name)).endswith(".md"), F.regexp_replace(col(name), r"(?i)\.md$", ".note"))


def remote_rank(name: Column | str) -> Column:
    """Which of two remote names for one path is preferred: Markdown over note kinds over none."""
    return F.when(col(name).rlike(r"(?i)\.md$"), 2).when(col(name).rlike(r"(?i)\.(note|clip)$"), 1).otherwise(0)


def ancestor_depth(a: Column | str, b: Column | str) -> Column:
    """How many leading directory segments two paths share."""
    parts = lambda p: F.when(dirname(p) == "", F.array().cast("array<string>")).otherwise(F.split(dirname(p), "/"))
    same = F.zip_with(parts(a), parts(b), lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def is_root_level(path: Column | str) -> Column:
    return ~col(path).contains("/")


def is_text(path: Column | str) -> Column:
    return extension(path).isin(*TEXT_EXTENSIONS)


def is_comparable(path: Column | str) -> Column:
    """Files whose remote content is fetched to settle a conflict."""
    return extension(path).isin(*COMPARABLE_EXTENSIONS)


def is_asset(path: Column | str) -> Column:
    return extension(path).isin(*ASSET_EXTENSIONS)


def is_conflict(path: Column | str) -> Column:
    return col(path).contains(".conflict.")


def is_artifact_dir(path: Column | str) -> Column:
    return F.lower(col(path)).rlike(r"(^|/)(images|attachments|[^/]*\.media)(/|$)")


def mime(path: Column | str) -> Column:
    known = F.create_map(*(F.lit(x) for pair in MIME.items() for x in pair))
    return F.coalesce(known[extension(path)], F.lit("application/octet-stream"))


#: The parts of a glob: wildcards, sets of characters, and any other character.
GLOB = re.compile(r"(?P<many>\*)|(?P<one>\?)|\[(?P<none>!?)(?P<set>.[^\]]*)\]|(?P<other>.)", re.S)


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression, anchored at a segment; ``*`` crosses ``/``."""
    spelling = {"many": lambda m: ".*", "one": lambda m: ".", "set": lambda m: "[" + "^" * len(m["none"]) + m["set"].replace("\\", "\\\\") + "]", "other": lambda m: re.escape(m["other"])}
    return "(^|/)" + GLOB.sub(lambda m: spelling[m.lastgroup](m), pattern) + "$"


def allowed(path: Column | str, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Exclusion wins; an empty inclusion takes everything."""
    some = lambda patterns: F.lit(False) if not patterns else col(path).rlike("|".join(f"({glob_regex(p)})" for p in patterns))
    return ~some(exclude or []) & (some(include) if include else F.lit(True))


def file_size(n: Column | str, half_even: bool = False) -> Column:
    """Bytes in B, KB, MB or GB with one decimal: of two equally near ones the
    larger, or the even one (as ``printf`` does) if ``half_even``."""
    x = col(n)
    near = (lambda v: F.bround(v, 1)) if half_even else (lambda v: v)
    text = lambda k, unit: F.format_string(f"%.1f {unit}", near(x / float(1 << 10 * k)))
    return F.when(x < 1 << 10, F.format_string("%d B", x.cast("long"))).when(x < 1 << 20, text(1, "KB")).when(x < 1 << 30, text(2, "MB")).otherwise(text(3, "GB"))


def seconds(ts: Column | str) -> Column:
    """Epoch seconds from seconds or milliseconds."""
    return F.when(col(ts) > 10**12, F.floor(col(ts) / 1000)).otherwise(col(ts)).cast("long")


def short_location(url: Column | str, line: Column | str) -> Column:
    return F.concat(F.substring_index(col(url), "/", -2), F.lit(":"), col(line))


# --- names of notes, clips, diaries ---------------------------------------------

# Domains of notes and of Markdown files.
NOTE_DOMAIN, MARKDOWN_DOMAIN = 0, 1


def domain_of_name(name: Column | str) -> Column:
    """Notes, clips and names without an extension are notes."""
    note = F.lower(col(name)).rlike(r"\.(note|clip)$") | (extension(name) == "")
    return F.when(note, NOTE_DOMAIN).otherwise(MARKDOWN_DOMAIN)


def cached_name(path: Column | str, domain: Column | str) -> Column:
    """The remote name of a stored path: notes were stored as Markdown."""
    own = basename(normalize_separators(path))
    return F.when(col(domain) == NOTE_DOMAIN, F.coalesce(official_name(own), own)).otherwise(own)


def without_stem_blanks(path: Column | str) -> Column:
    """No white space between the stem of the name and its extension."""
    name = basename(path)
    dotted = name.contains(".")
    ext = F.when(dotted, F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise("")
    front = F.when(dotted, F.substring(name, F.lit(1), F.length(name) - F.length(ext))).otherwise(name)
    return F.concat(F.substring(col(path), F.lit(1), F.length(col(path)) - F.length(name)), F.rtrim(front, F.lit(BLANKS)), ext)


def mapped_path(folder: Column | str, name: Column | str) -> Column:
    """Path of a file of a folder under its mapped name."""
    return join_path(folder, map_remote_name(name))


def media_dir(path: Column | str) -> Column:
    """Folder of a voice note's clips."""
    return F.concat(F.regexp_replace(col(path), r"(?i)\.audio$", ""), F.lit(".media"))


def clip_extension(data: Column | str) -> Column:
    """By the first bytes of a clip (binary)."""
    start = F.hex(F.substring(col(data), 1, 4))
    return F.when(start.rlike("^4F6767.."), ".ogg").when(start.startswith("494433"), ".mp3").when(start.rlike("^FFF"), ".aac").otherwise(".bin")


def clip_name(index: Column | str, record: Column | str, ext: Column | str) -> Column:
    number = col(index).cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return F.concat(padded, F.lit("-"), col(record), col(ext))


def is_clip_of(name: Column | str, record: Column | str) -> Column:
    return F.regexp_extract(col(name), r"^\d{3}-(.+)\.[^.]+$", 1) == col(record)


def is_diary_name(name: Column | str) -> Column:
    return col(name).rlike(r"^\d{4}年\d{1,2}月\d{1,2}日(\.(md|note))?$")


def stem_date(stem: Column | str) -> Column:
    """ISO date of a diary's stem; null for other stems."""
    part = lambda k: F.regexp_extract(col(stem), r"^(\d{4})年(\d{1,2})月(\d{1,2})日$", k)
    return F.when(is_diary_name(stem) & (part(1) != ""), F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))


def dated(prefix: Column | str, day: Column) -> Column:
    return F.concat_ws("-", col(prefix), F.date_format(day, "yyyy-MM-dd"))


def trash_path(path: Column | str, day: Column) -> Column:
    return F.concat_ws("/", F.lit(".trash"), F.date_format(day, "yyyy-MM-dd"), col(path))


def is_watched(path: Column | str) -> Column:
    """Changes of these files start a sync."""
    p = col(path)
    return p.rlike(r"\.(md|note)$") & ~p.rlike(r"\.git[/\\]") & ~is_conflict(path)


def is_denied(command: Column | str, pattern: str) -> Column:
    return F.coalesce((col(command) != "") & col(command).rlike(pattern), F.lit(False))


# --- values as text ----------------------------------------------------------------


def milliseconds(ms: Column | str) -> Column:
    x = col(ms)
    return F.when(x < 1, F.format_string("%.0fµs", x * 1000.0)).when(x < 1000, F.format_string("%.1fms", x * 1.0)).otherwise(F.format_string("%.2fs", x / 1000.0))


def microseconds(us: Column | str) -> Column:
    x = col(us)
    return F.when(x < 1000, F.concat(x.cast("string"), F.lit("µs"))).when(x < 1_000_000, F.format_string("%.1fms", x / 1000.0)).otherwise(F.format_string("%.2fs", x / 1_000_000.0))


def percent(part: Column | str, total: Column | str) -> Column:
    return F.when(col(total) > 0, F.format_string("%.1f%%", col(part) / col(total) * 100.0)).otherwise("-")


def number(value: Column | str, fallback: float | int = 0) -> Column:
    """A number from whatever text; ``fallback`` if it is none."""
    return F.coalesce(col(value).try_cast("double"), F.lit(float(fallback)))


def listed_time(mtime: Column | str) -> Column:
    """Minute of a listing's time; the value in seconds is taken as milliseconds, as listings do."""
    return F.when(col(mtime) > 0, F.date_format(F.timestamp_millis(col(mtime).cast("long")), "yyyy-MM-dd HH:mm")).otherwise("-")


def listing_line(id_: Column | str, name: Column | str, is_dir: Column | str, size: Column | str, mtime: Column | str) -> Column:
    """What a listing shows of an entry: nulls as defaults, size and time as text too."""
    size, mtime = (F.coalesce(col(c).cast("long"), F.lit(0).cast("long")) for c in (size, mtime))
    folder = F.coalesce(col(is_dir), F.lit(False))
    label = F.coalesce(F.nullif(col(name), F.lit("")), F.lit("(unnamed)"))
    fields = {"id": col(id_), "name": label, "is_dir": folder, "size": size, "size_text": F.when(size > 0, file_size(size)).otherwise("-"), "modified": mtime, "time_text": listed_time(mtime), "type": F.when(folder, "folder").otherwise("file")}
    return F.struct(*(value.alias(key) for key, value in fields.items()))


def template(text: Column | str, values: dict[str, Column]) -> Column:
    """``{key}`` replaced by each key's value."""
    out = col(text)
    for key, value in values.items():
        out = F.replace(out, F.lit("{" + key + "}"), value)
    return out


def commit_message(now: Column, counts: dict[str, Column], message: Column | None = None) -> Column:
    """The given message, or one from the counts that aren't zero."""
    stamp = F.date_format(now, "yyyy-MM-dd HH:mm:ss")
    marks = {"downloaded": "↓", "uploaded": "↑", "conflicts": "⚡", "dedup_deleted": "🗑"}  # fixed values
    parts = F.concat_ws(" ", *(F.when(counts[k] != 0, F.concat(F.lit(m), counts[k].cast("string"))) for k, m in marks.items() if k in counts))
    own = F.concat(F.lit("sync: "), F.when(parts != "", parts).otherwise("auto-commit"), F.lit(" ("), stamp, F.lit(")"))
    return own if message is None else F.coalesce(F.nullif(message, F.lit("")), own)
