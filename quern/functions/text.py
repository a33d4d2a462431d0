"""Text, number, date and address functions. All but ``slugify`` are built of native expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLANK = r"[\s\x{FEFF}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def trim(c: Column) -> Column:
    """Without white space at the ends: tabs, line ends, no-break spaces and byte-order marks too."""
    return F.regexp_replace(c, f"^{_BLANK}+|{_BLANK}+$", "")


def contains_fold(c: Column, part: str | Column) -> Column:
    part = F.lit(part.lower()) if isinstance(part, str) else F.lower(part)
    return F.contains(F.lower(c), part)


def blank_to(c: Column, other: Column | str) -> Column:
    """Other where c is null or empty."""
    return F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(other if isinstance(other, Column) else F.lit(other))


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def parse_int(c: Column, other: int) -> Column:
    """The whole number that a text starts with; other for none, for 0 and for one that no long holds. Decimal digits only."""
    got = F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("long")
    return F.coalesce(F.when(got != 0, got), F.lit(other).cast("long"))


def parse_float(c: Column) -> Column:
    return F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def slug(value: str | None) -> str | None:
    """Latin letters without marks, digits and hyphens."""
    if value is None:
        return None
    plain = unicodedata.normalize("NFD", value.lower().replace("đ", "d"))
    plain = "".join(x for x in plain if not unicodedata.combining(x))
    return re.sub(r"[^a-z0-9]+", "-", plain).strip("-")


@F.pandas_udf(T.StringType())
def slugify(values: pd.Series) -> pd.Series:
    """Python, because SQL has no decomposition of marks."""
    return values.map(slug, na_action="ignore")


def slug_field(value: Column, title: Column) -> Column:
    """A slug that was given is tidied; without one it comes from the title, on every save. An empty text was given."""
    return slugify(F.coalesce(value, title))


def menu_title(title: Column, slug: Column) -> Column:
    """The title as it stands, or the trimmed slug where the title is blank."""
    return F.when(F.length(trim(F.coalesce(title, F.lit("")))) > 0, title).otherwise(trim(slug))


def lab_title(title: Column, slug: Column) -> Column:
    """Without a "Lab" (or "La") at the end."""
    return blank_to(trim(F.regexp_replace(title, r"(?i)\s*Lab?$", "")), slug)


def day(c: Column) -> Column:
    return F.date_format(c, "dd/MM/yyyy")


def moment(c: Column) -> Column:
    """A text as time and day; as it stands if it is no timestamp."""
    return F.coalesce(F.date_format(F.try_to_timestamp(c), "HH:mm:ss d/M/yyyy"), c)


def lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), trim), lambda x: x != "")


def csv_field(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def host(url: Column) -> Column:
    """In lower case, without the first "www."."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^(.*?)www\.", "$1")


def embed_url(url: Column) -> Column:
    """The address of the embedded player for the video sites known; null for others. What follows the prefix is the name, slashes included."""
    h, path = host(url), F.try_parse_url(url, F.lit("PATH"))
    after = lambda prefix: F.regexp_replace(path, f"^{prefix}", "")
    long = h.isin("youtube.com", "m.youtube.com")
    name = (
        F.when(h == "youtu.be", after("/"))
        .when(long & path.startswith("/embed/"), after("/embed/"))
        .when(long & (path == "/watch"), F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit("v"))))
        .when(long & path.startswith("/shorts/"), after("/shorts/"))
    )
    return F.when(name != "", F.concat(F.lit("https://www.youtube.com/embed/"), name))


def cookie(header: Column, name: str) -> Column:
    """The first cookie of that name, percent-decoded; a plus sign stays. Null where it has no value, or an empty one."""
    parts = F.transform(F.split(header, ";"), trim)
    own = F.filter(parts, lambda x: F.substring_index(x, "=", 1) == name)
    value = F.get(own, F.lit(0))
    raw = F.when(F.contains(value, F.lit("=")), F.regexp_replace(value, "(?s)^[^=]*=", ""))
    return F.when(raw != "", F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))))


def _attribute(tag: Column, name: str) -> Column:
    found = F.regexp_extract_all(tag, F.lit(rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"), F.lit(1))
    value = F.get(found, F.lit(0))
    return F.when(value.rlike("^[\"']"), F.regexp_replace(value, "^[\"']|[\"']$", "")).otherwise(value)


def meta_content(html: Column, name: str) -> Column:
    """The content of the page's first meta tag of that name, trimmed; null where there is none or it is blank. Character references stay as they are."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"), F.lit(0))
    own = F.filter(tags, lambda t: F.coalesce(_attribute(t, "name"), F.lit("")) == name)
    value = trim(_attribute(F.get(own, F.lit(0)), "content"))
    return F.when(value != "", value)


#: Where a request's token is looked for, in this order: meta tags, then cookies.
TOKEN_METAS = ("csrf-token", "csrf_token", "xsrf-token", "xsrf_token")
TOKEN_COOKIES = ("csrf-token", "csrf_token", "XSRF-TOKEN", "xsrf-token", "xsrf_token")


def token(html: Column, cookies: Column) -> Column:
    """The first token that a meta tag or a cookie holds."""
    return F.coalesce(*[meta_content(html, n) for n in TOKEN_METAS], *[cookie(cookies, n) for n in TOKEN_COOKIES])


def error_detail(body: Column, fallback: Column | str) -> Column:
    """``detail`` of a JSON body if it is a text, or detail.detail if that is; else the fallback."""
    v = F.try_parse_json(body)
    text = lambda path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    return F.coalesce(text("$.detail"), text("$.detail.detail"), fallback if isinstance(fallback, Column) else F.lit(fallback))


def query_string(pairs: Sequence[tuple[str, Column]]) -> Column:
    """name=value of those with a value, joined by &."""
    return F.concat_ws("&", *[F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{k}="), F.url_encode(c.cast("string")))) for k, c in pairs])


def set_parameter(params: Column, name: str, value: Column) -> Column:
    """A map of parameters with one of them set."""
    return F.map_concat(F.map_filter(params, lambda k, _: k != name), F.create_map(F.lit(name), value))


#: Where the pages of a collection live.
PREFIXES = {"news": "/news", "courses": "/courses", "solutions": "/solutions", "research-labs": "/research/r&d-labs"}


def detail_link(prefix: Column | str, slug: Column) -> Column:
    return F.concat(prefix if isinstance(prefix, Column) else F.lit(prefix), F.lit("/"), slug)


def preview_path(collection: Column, slug: Column, secret: Column) -> Column:
    """Every parameter is named, empty or not."""
    prefix = F.create_map(*[F.lit(x) for pair in PREFIXES.items() for x in pair])
    path = detail_link(F.try_element_at(prefix, collection), slug)
    pairs = (("slug", slug), ("collection", collection), ("path", path), ("previewSecret", F.coalesce(secret, F.lit(""))))
    return F.concat(F.lit("/api/draft?"), F.concat_ws("&", *[F.concat(F.lit(f"{k}="), F.url_encode(c)) for k, c in pairs]))


def preview_status(secret_ok: Column, path: Column, collection: Column, slug: Column, failed: Column, user: Column) -> Column:
    """The status of a preview request: the first test that fails decides; 302 sends it on."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.when(~F.coalesce(secret_ok, F.lit(False)), 403).when(~given(path) | ~given(collection) | ~given(slug), 404).when(~path.startswith("/"), 500)
        .when(failed, 403).when(user.isNull(), 401).otherwise(302)
    )


def server_url(public: Column, production: Column) -> Column:
    """The site's own address as its server knows it: the one given, else the production host, else the local one."""
    return F.coalesce(blank_to(public, F.lit(None).cast("string")), F.concat(F.lit("https://"), blank_to(production, F.lit(None).cast("string"))), F.lit("http://localhost:3000"))


def client_url(protocol: Column, hostname: Column, port: Column, production: Column, public: Column) -> Column:
    """The same as a browser knows it (protocol "https:", and so on); without a browser (hostname null) the production host, else the one given, else empty."""
    seen = F.concat(protocol, F.lit("//"), hostname, F.when(F.coalesce(port, F.lit("")) != "", F.concat(F.lit(":"), port)).otherwise(""))
    return F.coalesce(seen, F.concat(F.lit("https://"), blank_to(production, F.lit(None).cast("string"))), public, F.lit(""))


def message_id(at: Column) -> Column:
    """Milliseconds since 1970 as text. Not unique in bulk."""
    return F.unix_millis(at).cast("string")


def with_prefix(path: Column, prefix: str) -> Column:
    return F.when(path.startswith("http"), path).otherwise(F.concat(F.lit(prefix), path))


def citation(authors: Column, title: Column, year: Column) -> Column:
    return F.format_string('%s, "%s" (%d)', authors, title, year)


def position(items: Column, key: Column | str) -> Column:
    """From 0; 0 also where the key is missing."""
    return F.greatest(F.array_position(items, key) - 1, F.lit(0))


def toggled(items: Column, item: Column | str) -> Column:
    """Without the item if it is there, with it at the end if not."""
    item = item if isinstance(item, Column) else F.lit(item)
    return F.when(F.array_contains(items, item), F.array_remove(items, item)).otherwise(F.array_append(items, item))


def plain_text(rich: Column) -> Column:
    """The text leaves of a rich-text tree kept as JSON, joined by spaces."""
    return F.array_join(F.transform(F.regexp_extract_all(rich, F.lit(r'"text"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1)), lambda x: F.coalesce(F.get_json_object(F.concat(F.lit('{"t":"'), x, F.lit('"}')), "$.t"), x)), " ")
