"""Scalar expressions: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# strings


def unicode_trim(s: Column) -> Column:
    """Trims all Unicode white space, not only U+0020."""
    return F.regexp_replace(s, r"^[\p{Z}\s\x85]+|[\p{Z}\s\x85]+$", "")


def simplify(s: Column) -> Column:
    """Trimmed, with runs of white space as one space."""
    return F.regexp_replace(unicode_trim(s), r"[\p{Z}\s\x85]+", " ")


def pascal_case(s: Column) -> Column:
    """``text_to_speech`` to ``TextToSpeech``; names without underscore stay."""
    return F.when(F.contains(s, F.lit("_")), F.replace(F.initcap(F.replace(s, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))).otherwise(s)


def provider_and_model(s: Column) -> Column:
    """struct(provider, model) cut at the first slash; null unless both are there."""
    at = F.instr(s, "/")
    return F.when((at > 1) & (at < F.length(s)), F.struct(F.substring(s, F.lit(1), at - 1).alias("provider"), F.substring(s, at + 1, F.length(s)).alias("model")))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last extension, in lower case; empty if none."""
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]*)$", 1))


def base_name(path: Column) -> Column:
    """The file name up to its first dot."""
    return F.regexp_extract(file_name(path), r"^([^.]*)", 1)


def rewrite_mount(path: Column, mounts: dict[str, str]) -> Column:
    """The path with the first matching mount prefix replaced."""
    out = path
    for source, target in reversed(list(mounts.items())):
        out = F.when(F.startswith(path, F.lit(source)), F.concat(F.lit(target), F.substring(path, F.lit(len(source) + 1), F.length(path)))).otherwise(out)
    return out


def sanitise_file_name(s: Column) -> Column:
    return F.regexp_replace(s, r'[\\/:*?"<>|]', "_")


def has_cjk(s: Column) -> Column:
    return F.rlike(s, F.lit("[\\x{4E00}-\\x{9FBF}]"))


def text_range(s: Column, start: int, length: int) -> Column:
    """Code points from ``start`` (from 0); empty if out of bounds."""
    return F.when((F.length(s) > start) & F.lit(start >= 0) & F.lit(length > 0), F.substring(s, start + 1, length)).otherwise("")


def html_to_text(page: Column) -> Column:
    """Text of a page: scripts, comments and tags go, common entities are written out."""
    hidden = "|".join(rf"<{tag}\b.*?</{tag}\s*>" for tag in ("script", "style", "title"))
    text = F.regexp_replace(page, f"(?is)<!--.*?-->|{hidden}", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return simplify(text)


def looks_textual(data: Column) -> Column:
    """A binary column that decodes as UTF-8 and has no NUL byte."""
    text = F.when(F.is_valid_utf8(data.cast("string")), data.cast("string"))
    return F.coalesce(~F.contains(text, F.lit("\x00")), F.lit(False))


# dates and durations


def compact_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss")


def clock(millis: Column) -> Column:
    """Milliseconds as HHMMSS; the hours have two digits at least."""
    seconds = F.floor(millis / 1000)
    hours = F.floor(seconds / 3600).cast("string")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours), two(F.floor(seconds / 60) % 60), two(seconds % 60))


def duration_seconds(s: Column) -> Column:
    """``H:M:S`` in seconds; null for another form."""
    parts = F.split(s, ":")
    number = lambda k: F.try_element_at(parts, F.lit(k)).cast("double")
    return F.when(F.rlike(s, F.lit(r"^\d+:\d+:\d+(\.\d+)?$")), number(1) * 3600 + number(2) * 60 + number(3))


# structures


def region(s: Column) -> Column:
    """``x,y,w,h`` or ``x1,y1;x2,y2`` as struct(x, y, width, height); null if invalid."""
    parts = F.transform(F.split(s, "[,;]"), lambda p: F.trim(p).try_cast("int"))
    n = lambda k: F.try_element_at(parts, F.lit(k))
    whole = (F.size(parts) == 4) & ~F.exists(parts, lambda p: p.isNull())
    rect = lambda x, y, w, h: F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))
    corners = rect(F.least(n(1), n(3)), F.least(n(2), n(4)), F.abs(n(3) - n(1)), F.abs(n(4) - n(2)))
    one, two = F.rlike(s, F.lit("^[^,;]*(,[^,;]*){3}$")), F.rlike(s, F.lit("^[^,;]*,[^,;]*;[^,;]*,[^,;]*$"))
    return F.when(whole & one, rect(n(1), n(2), n(3), n(4))).when(whole & two, corners)


def percent_of(used: Column, limit: Column) -> Column:
    return F.when(limit > 0, used * 100.0 / limit).otherwise(0.0)


def frames(data: Column, size: int = 8000) -> Column:
    """Binary in slices of ``size`` bytes, the last one shorter."""
    count = F.ceil(F.length(data) / F.lit(size)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda k: F.substring(data, k * size + 1, F.lit(size)))
    return F.when(F.length(data) > 0, cut).otherwise(F.array().cast("array<binary>"))


def sse_payloads(body: Column) -> Column:
    """The JSON payloads of a server-sent event body, one a line."""
    return F.regexp_extract_all(body, F.lit(r"(?m)^data: (\{.*\})\s*$"), 1)


def base64_line(data: Column) -> Column:
    """Base64 without line breaks."""
    return F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))


def multimodal_message(role: Column, text: Column, url: Column, mime: Column, data: Column) -> Column:
    """JSON of a message with an optional text part and an image by URL or inline."""
    shape = "struct<type: string, text: string, image_url: struct<url: string>>"
    words = F.when(F.length(text) > 0, F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("struct<url: string>").alias("image_url")))
    place = F.coalesce(url, F.concat(F.lit("data:image/"), mime, F.lit(";base64,"), base64_line(data)))
    image = F.when(place.isNotNull(), F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(place.alias("url")).alias("image_url")))
    return F.to_json(F.struct(role.alias("role"), F.array_compact(F.array(words.cast(shape), image.cast(shape))).alias("content")))


def ocr_result(boxes: Column, confidence: float = 1.0) -> Column:
    """JSON of recognised boxes (struct text, x, y, width, height, angle) with their corner points."""
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    item = lambda b: F.struct(
        b["text"].alias("text"), F.lit(confidence).alias("confidence"), b["angle"].alias("angle"),
        F.array(corner(b["x"], b["y"]), corner(b["x"] + b["width"], b["y"]), corner(b["x"] + b["width"], b["y"] + b["height"]), corner(b["x"], b["y"] + b["height"])).alias("points"),
    )
    return F.to_json(F.struct(F.array_join(F.transform(boxes, lambda b: b["text"]), "\n").alias("text"), F.transform(boxes, item).alias("boxes")))


def error_object(code: Column, message: Column) -> Column:
    return F.to_json(F.struct(F.lit(True).alias("error"), code.alias("error_code"), message.alias("error_message")))


def without_keys(params: Column, excluded: list[str]) -> Column:
    """A map without some keys."""
    return F.map_filter(params, lambda k, _: ~k.isin(excluded))


# enums

#: Service types by group.
SERVICE_GROUPS = {
    "NLP": ["Chat", "FunctionCalling"],
    "Speech": ["TextToSpeech", "SpeechToText"],
    "Vision": ["ImageRecognition", "OCR", "ImageGeneration", "ImageEditing", "ImageClassification"],
    "Embedding": ["TextEmbedding", "VectorSearch", "SemanticSearch"],
}


def service_type(s: Column) -> Column:
    """The service type of a name in either spelling; unknown names are Chat."""
    known = [t for group in SERVICE_GROUPS.values() for t in group]
    name = pascal_case(s)
    return F.when(name.isin(known), name).otherwise("Chat")


def service_group(kind: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for group, kinds in SERVICE_GROUPS.items():
        out = out.when(kind.isin(kinds), F.lit(group))
    return out.otherwise("Unknown")


#: Document types by suffix; others are text.
DOCUMENT_TYPES = {
    "pdf": ["pdf"],
    "office": ["doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "odp", "wps"],
    "image": ["png", "jpg", "jpeg", "bmp", "gif", "tiff", "webp"],
    "html": ["html", "htm"],
}


def document_type(path: Column) -> Column:
    ext, out = suffix(path), F.when(F.lit(False), F.lit(""))
    for kind, endings in DOCUMENT_TYPES.items():
        out = out.when(ext.isin(endings), F.lit(kind))
    return out.otherwise("text")


def image_format(s: Column, known: tuple[str, ...] = ("jpg", "png", "bmp", "gif", "webp")) -> Column:
    """The format's usual name, null if it isn't known."""
    name = F.when(F.lower(s) == "jpeg", "jpg").otherwise(F.lower(s))
    return F.when(name.isin(list(known)), name)


# predicates


def id_valid(s: Column, longest: int = 64) -> Column:
    return F.coalesce((F.length(s) > 0) & (F.length(s) <= longest), F.lit(False))


def path_allowed(path: Column, blacklist: list[str], longest: int = 4095, deepest: int = 20) -> Column:
    """Not below a listed prefix, not hidden, not too long and not too deep."""
    listed = F.exists(F.array(*[F.lit(p) for p in blacklist]).cast("array<string>"), lambda p: F.startswith(path, p))
    depth = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    return ~listed & ~F.contains(path, F.lit("/.")) & (F.length(path) <= longest) & (depth <= deepest)


def index_config_valid(kind: Column, dimension: Column, metric: Column) -> Column:
    return kind.between(1, 5) & dimension.between(1, 10_000) & F.coalesce(metric, F.lit(1)).between(1, 3)


def admits(used: Column, required: Column, limit: Column) -> Column:
    return used + required <= limit


def healthy(memory: Column, cpu: Column, disk: Column) -> Column:
    """Percentages below what a loaded machine may have."""
    return (memory <= 90) & (cpu <= 95) & (disk <= 95)


def stage_ready(dependencies: Column, done: Column) -> Column:
    """Whether all stages that a stage depends on are done (arrays of names)."""
    return F.forall(dependencies, lambda d: F.array_contains(done, d))


def stage_results_valid(results: Column, required: list[str]) -> Column:
    """A map of results that has all required keys with values that aren't empty."""
    keys = F.array(*[F.lit(k) for k in required]).cast("array<string>")
    return F.forall(keys, lambda k: F.coalesce(F.length(F.try_element_at(results, k)) > 0, F.lit(False)))


def providers_or_default(providers: Column, default: list[str]) -> Column:
    """Distinct providers in order, or the default list when there are none."""
    own = F.array_sort(F.array_distinct(F.coalesce(providers, F.array().cast("array<string>"))))
    return F.when(F.size(own) > 0, own).otherwise(F.array(*[F.lit(x) for x in default]).cast("array<string>"))


def look_up(name: Column, table: dict[str, str]) -> Column:
    """The value of a name without regard to case; empty if unknown."""
    out = F.when(F.lit(False), F.lit(""))
    for k, v in table.items():
        out = out.when(F.lower(name) == k.lower(), F.lit(v))
    return out.otherwise("")


def progress(done: Column, total: Column) -> Column:
    """Percent done; 0 when there is nothing to do."""
    return F.when(total > 0, done * 100.0 / total).otherwise(0.0)


def functions_valid(definitions: Column) -> Column:
    """A JSON array, not empty, of objects with a name."""
    parsed = F.from_json(definitions, "array<struct<name: string>>")
    return F.coalesce((F.size(parsed) > 0) & F.forall(parsed, lambda f: F.length(f["name"]) > 0), F.lit(False))


#: Suffixes that can be indexed, kinds of resources and of models.
INDEXED_SUFFIXES = "txt text doc docx xls xlsx ppt pptx pps ppsx pdf wps dps".split()
RESOURCES = "memory cpu disk network gpu".split()
MODEL_TYPES = "embedding parser tts llm".split()


def indexable(path: Column) -> Column:
    """Whether a file's last suffix, as it is written, can be indexed."""
    return F.regexp_extract(file_name(path), r"\.([^.]*)$", 1).isin(INDEXED_SUFFIXES)


def below(path: Column, folder: str) -> Column:
    """Whether a path is a folder or lies below it."""
    place = folder.rstrip("/")
    return (path == place) | F.startswith(path, F.lit(place + "/"))


def config_key_valid(key: Column, longest: int = 256) -> Column:
    return id_valid(key, longest)


def has_architecture(architectures: Column, name: str = "embedding") -> Column:
    """Whether a list of architectures has a name, without regard to case."""
    return F.coalesce(F.exists(architectures, lambda a: F.lower(a) == name.lower()), F.lit(False))


def decoded(data: Column) -> Column:
    """Binary as text: UTF-16 by its byte order mark, else UTF-8 if it is that, else
    Latin-1, which no bytes fail; a UTF-8 mark is no part of the text."""
    mark = F.upper(F.hex(F.substring(data, 1, 3)))
    rest = lambda n: F.substring(data, F.lit(n + 1), F.length(data))
    utf8 = F.when(mark == "EFBBBF", rest(3).cast("string")).when(F.is_valid_utf8(data.cast("string")), data.cast("string"))
    wide = F.when(F.startswith(mark, F.lit("FFFE")), F.decode(rest(2), "UTF-16LE")).when(F.startswith(mark, F.lit("FEFF")), F.decode(rest(2), "UTF-16BE"))
    return F.coalesce(wide, utf8, F.decode(data, "ISO-8859-1"))


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds from one time to another."""
    return F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))


def audio_message(data: Column, status: Column) -> Column:
    """JSON of an audio frame, its bytes as Base64."""
    return F.to_json(F.struct(F.struct(status.alias("status"), base64_line(data).alias("audio")).alias("data")))


def stable_id(*parts: Column, length: int = 32) -> Column:
    """An id made from values, the same for the same ones; null and empty differ."""
    text = F.concat(*[F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts])
    return F.substring(F.sha2(text, 256), 1, length)


def big_endian(data: Column, at: int, width: int) -> Column:
    """An unsigned number of ``width`` bytes from offset ``at``."""
    return F.conv(F.hex(F.substring(data, at + 1, width)), 16, 10).cast("long")


def little_endian(data: Column, at: int, width: int) -> Column:
    return F.conv(F.hex(F.reverse(F.substring(data, at + 1, width).cast("binary"))), 16, 10).cast("long") if width == 1 else sum((big_endian(data, at + k, 1) * (1 << (8 * k)) for k in range(1, width)), big_endian(data, at, 1))


def image_size(data: Column) -> Column:
    """struct(width, height) of PNG, GIF and BMP files by their headers; null for others."""
    size = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    mark = F.hex(F.substring(data, 1, 8))
    return (
        F.when(mark == "89504E470D0A1A0A", size(big_endian(data, 16, 4), big_endian(data, 20, 4)))
        .when(F.startswith(mark, F.lit("47494638")), size(little_endian(data, 6, 2), little_endian(data, 8, 2)))
        .when(F.startswith(mark, F.lit("424D")), size(little_endian(data, 18, 4), little_endian(data, 22, 4)))
    )


#: Fixed value: pixels that a recognised image has at most on its longer side.
LONGEST_SIDE = 1024


def fitted_size(width: Column, height: Column, longest: int = LONGEST_SIDE) -> Column:
    """struct(width, height) of an image scaled down, in proportion, to the longest side."""
    side = F.greatest(width, height)
    scaled = lambda x: F.when(side > longest, F.greatest(F.round(x * F.lit(float(longest)) / side), F.lit(1.0)).cast("int")).otherwise(x.cast("int"))
    return F.struct(scaled(width).alias("width"), scaled(height).alias("height"))


def wave_seconds(data: Column) -> Column:
    """Length of a plain WAVE file by its header: bytes of sound over bytes a second."""
    mark = F.concat(F.hex(F.substring(data, 1, 4)), F.hex(F.substring(data, 9, 4)))
    return F.when((mark == "5249464657415645") & (F.length(data) >= 44), little_endian(data, 40, 4) / little_endian(data, 28, 4))
