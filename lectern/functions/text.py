"""Text functions: Column -> Column, all built from built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(c: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalise(c: Column | str) -> Column:
    """Lower case, trimmed, white space runs as one space, then signs removed (so two spaces may meet again)."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    return F.regexp_replace(spaced, r"[^\p{L}\p{N}_\s]", "")


def slug(c: Column | str, longest: int = 100) -> Column:
    """A name for a folder: other signs and white space as one underscore, none at the ends; blank gives 'unknown'."""
    one = F.regexp_replace(F.regexp_replace(F.trim(c), r"[^\p{L}\p{N}_\s-]", "_"), r"[\s_]+", "_")
    cut = F.substring(F.regexp_replace(one, "^_+|_+$", ""), 1, longest)
    return F.when(F.coalesce(cut, F.lit("")) == "", "unknown").otherwise(cut)


def safe_title(c: Column | str) -> Column:
    """The first 50 characters that may stand in a file name."""
    return F.regexp_replace(F.substring(c, 1, 50), r"[^\p{L}\p{N} _-]", "")


def shortened(c: Column | str, n: int = 300) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def arxiv_id(url: Column | str) -> Column:
    """The paper id in an abs or pdf address, or ''."""
    u = F.col(url) if isinstance(url, str) else url
    new = F.regexp_extract(u, r"arxiv\.org/(?:abs|pdf)/([0-9]{4}\.[0-9]{4,5})", 1)
    return F.coalesce(F.nullif(new, F.lit("")), F.regexp_extract(u, r"arxiv\.org/(?:abs|pdf)/([a-z-]+/[0-9]{7})", 1))


def has_cjk(c: Column | str) -> Column:
    return F.rlike(c, F.lit("[一-鿿]"))


def has_tags(c: Column | str) -> Column:
    return F.rlike(c, F.lit("<(p|div|a|span|html|body|br)[^>]*>"))


def is_http(c: Column | str) -> Column:
    return F.startswith(c, F.lit("http://")) | F.startswith(c, F.lit("https://"))


def is_image(c: Column | str) -> Column:
    lowered = F.lower(c)
    return F.rlike(lowered, F.lit("(jpg|jpeg|png|gif|bmp|webp|tiff)$"))


def urls(c: Column | str) -> Column:
    return F.regexp_extract_all(c, F.lit(r"https?://[^ \t\n\r\f\x0B\"<>]+"), F.lit(0))


def markdown_links(c: Column | str) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1))


def first_fence(c: Column | str) -> Column:
    """The body of the first fenced code block, or the text itself."""
    body = F.regexp_extract(c, r"(?s)```[a-zA-Z]*\n(.*?)```", 1)
    return F.when(F.coalesce(body, F.lit("")) == "", F.col(c) if isinstance(c, str) else c).otherwise(stripped(body))


def url_basename(url: Column | str) -> Column:
    """The last part of an address' path, without query and fragment, decoded; without an id in front (uuid_)."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-z]+://[^/]*", "")
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}_", "")


def clean(c: Column | str, drop: str = "") -> Column:
    """Runs of line feeds as one, a given literal dropped, long rules as five dashes, trimmed."""
    t = F.regexp_replace(c, r"\n+", "\n")
    t = F.replace(t, F.lit(drop), F.lit("")) if drop else t
    return stripped(F.regexp_replace(t, r"-{6,}", "-----"))


def answer(c: Column | str) -> Column:
    """What stands between the first <answer> and the next </answer>, trimmed; null without."""
    found = F.regexp_extract(c, r"(?s)<answer>(.*?)</answer>", 1)
    return F.when(F.contains(c, F.lit("<answer>")) & F.contains(c, F.lit("</answer>")), stripped(found))


def termination(c: Column | str) -> Column:
    return F.when(F.contains(c, F.lit("<answer>")) & F.contains(c, F.lit("</answer>")), "answer").when(F.contains(c, F.lit("<tool_call>")), "tool call").otherwise("answer not found")


def tool_call(c: Column | str) -> Column:
    """The JSON text of the first tool call; null without."""
    found = F.regexp_extract(c, r"(?s)<tool_call>\s*(.*?)\s*</tool_call>", 1)
    return F.nullif(found, F.lit(""))


def before_response(c: Column | str) -> Column:
    return F.split_part(c, F.lit("<tool_response>"), F.lit(1))


def markdown_row(*cells: Column) -> Column:
    """|a|b|: null as None, line feeds as spaces."""
    return F.concat(F.lit("|"), F.concat_ws("|", *[F.replace(F.coalesce(x.cast("string"), F.lit("None")), F.lit("\n"), F.lit(" ")) for x in cells]), F.lit("|"))


def round_by(x: Column, factor: int) -> Column:
    return F.bround(x / factor).cast("long") * factor


def smart_resize(h: Column, w: Column, factor: int = 28, least: int = 256 * 28 * 28, most: int = 1280 * 28 * 28, ratio: int = 200) -> Column:
    """(height, width) as multiples of factor with an area between least and most; then a side over ratio times the other is cut to that."""
    h, w = h.cast("double"), w.cast("double")
    hb, wb = F.greatest(F.lit(factor), round_by(h, factor)), F.greatest(F.lit(factor), round_by(w, factor))
    shrink, grow = F.sqrt(h * w / most), F.sqrt(least / (h * w))
    down = lambda x: F.floor(x / shrink / factor).cast("long") * factor
    up = lambda x: F.ceil(x * grow / factor).cast("long") * factor
    over, under = hb * wb > most, hb * wb < least
    height, width = (F.when(over, down(x)).when(under, up(x)).otherwise(b) for x, b in ((h, hb), (w, wb)))
    return F.struct(F.least(height, width * ratio).alias("height"), F.least(width, height * ratio).alias("width"))


def keyframe_times(duration: Column, n: Column) -> Column:
    """n times, evenly inside the duration."""
    step = duration / (n + 1)
    return F.transform(F.sequence(F.lit(1), n), lambda i: step * i)


def data_url(content: Column | str, mime: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.base64(content))


def merged_config(a: Column, b: Column, lists: str | None = None) -> Column:
    """Maps of generation settings: the later one wins. Where values are lists, those under `lists` are united in order."""
    out = F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)
    if lists is None:
        return out
    both = F.array_union(F.coalesce(a[lists], F.array()), F.coalesce(b[lists], F.array()))
    return F.when(F.map_contains_key(a, lists) & F.map_contains_key(b, lists), F.map_concat(F.map_filter(out, lambda k, _: k != lists), F.create_map(F.lit(lists), both))).otherwise(out)


#: Endings that name a kind by themselves: fixed values.
KINDS = ("pdf", "docx", "pptx", "csv", "tsv", "xlsx", "xls", "zip", "mp3", "jsonl", "pdb", "py", "xml")


def file_kind(path: Column, mime: Column | None = None, content: Column | None = None) -> Column:
    """What a file or address holds: by its ending; of other addresses by the content type, of other files by tags in the text."""
    ending = F.lower(F.regexp_extract(url_basename(path), r"([^.]*)$", 1))
    mime = F.lit("") if mime is None else F.coalesce(mime, F.lit(""))
    web = F.when(F.contains(mime, F.lit("application/pdf")), "pdf").when(F.contains(mime, F.lit("application/msword")), "docx").otherwise("html")
    tags = F.lit(False) if content is None else F.rlike(content, F.lit("<(p|span|div|li|html|script)[^>]*?"))
    local = F.lit("unk") if content is None else F.when(content.isNull(), "unk").when(tags, "html").otherwise("txt")
    return F.when(is_image(path), "image").when(ending.isin(*KINDS), ending).when(is_http(path), web).otherwise(local)


def question_of(question: Column, message: Column) -> Column:
    """The question, or else the second message's text, of that what stands between the first and second `User:`; null if blank."""
    asked = F.when(F.contains(message, F.lit("User:")), stripped(F.split_part(message, F.lit("User:"), F.lit(2)))).otherwise(message)
    return F.nullif(F.coalesce(F.nullif(stripped(question), F.lit("")), asked), F.lit(""))


def truthy(values: Column) -> Column:
    """An array without nulls and empty texts."""
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))


def rendered_hit(i: Column, title: Column, url: Column, description: Column, date: Column, arxiv: Column) -> Column:
    """A numbered search hit as lines; description (300 characters), date and id only where there are any."""
    some = lambda label, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"    {label}: "), v))
    return F.concat_ws("\n", F.concat(F.lit("["), i.cast("string"), F.lit("] Title: "), title), F.concat(F.lit("    URL: "), url), some("Summary", F.substring(description, 1, 300)), some("Date", date), some("ArXiv ID", arxiv), F.lit(""))


def decoded(c: Column | str) -> Column:
    """The bytes of base64 text, with or without a data URL's head."""
    return F.unbase64(F.regexp_replace(c, "^data:[^,]*,", ""))


def short_side(h: Column, w: Column, side: int) -> Column:
    """(height, width) with the shorter side as given and the other in proportion."""
    scale = F.lit(float(side)) / F.least(h, w)
    return F.struct(F.round(h * scale).cast("long").alias("height"), F.round(w * scale).cast("long").alias("width"))


def lenient_json(c: Column | str, schema: str) -> Column:
    """A text's JSON, in a fence or bare, as schema; quotes, comments and keys may be written loosely. Null if it is none."""
    return F.from_json(first_fence(c), schema, {"allowComments": "true", "allowSingleQuotes": "true", "allowUnquotedFieldNames": "true", "mode": "PERMISSIVE"})
