"""Identifiers as columns: call-graph URIs, package URLs, coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = "cg"
PARTIAL = r"^/([^/]+)/([^.]+)\.([^(]+)\(([^)]*)\)(.+)$"
# Package types of package URLs and the ecosystem they belong to.
ECOSYSTEMS = {"maven": "mvn", "deb": "debian", "pypi": "PyPI"}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def percent_decode(x: Column | str) -> Column:
    """Percent-decoding that leaves '+' alone; null where the text is no valid encoding."""
    return F.try_url_decode(F.replace(_c(x), F.lit("+"), F.lit("%2B")))


def percent_decode_fully(x: Column | str, rounds: int = 3) -> Column:
    """Decoding until no '%' is left, ``rounds`` times at most."""
    out = _c(x)
    for _ in range(rounds):
        out = F.when(F.contains(out, F.lit("%")), F.coalesce(percent_decode(out), out)).otherwise(out)
    return out


def percent_encode_args(x: Column | str) -> Column:
    """The characters that are reserved inside an argument list, percent-encoded."""
    out = _c(x)
    for ch, code in (("%", "%25"), ("/", "%2F"), (",", "%2C"), ("(", "%28"), (")", "%29"), ("$", "%24"), ("!", "%21")):
        out = F.replace(out, F.lit(ch), F.lit(code))
    return out


def full_uri(forge: Column | str, product: Column | str, version: Column | str, partial: Column | str, scheme: str = SCHEME) -> Column:
    return F.concat(F.lit(f"{scheme}://"), _c(forge), F.lit("!"), _c(product), F.lit("$"), _c(version), _c(partial))


def split_full_uri(uri: Column | str, scheme: str = SCHEME) -> dict[str, Column]:
    """forge, product, version and partial URI; every part but the last may be missing (null)."""
    pattern = rf"^(?:{scheme}:)?(?://(?:([^!$/]*)!)?([^!$/]*)?(?:\$([^/]*))?)?(/.*)?$"
    part = lambda i: F.nullif(F.regexp_extract(_c(uri), pattern, i), F.lit(""))
    return {"forge": part(1), "product": part(2), "version": part(3), "partial": part(4)}


def split_partial_uri(uri: Column | str) -> dict[str, Column]:
    """namespace, class_name, method, args and returns of /namespace/Class.method(args)returns."""
    return {k: F.nullif(F.regexp_extract(_c(uri), PARTIAL, i + 1), F.lit("")) for i, k in enumerate(("namespace", "class_name", "method", "args", "returns"))}


def reference_parts(uri: Column | str, scheme: str = SCHEME) -> dict[str, Column]:
    """authority, namespace and entity of scheme://authority/namespace/entity, /namespace/entity or entity; missing parts are null."""
    pattern = rf"^(?:{scheme}:)?(?://([^/]*))?(?:/([^/]+)/)?(.*)$"
    part = lambda i: F.nullif(F.regexp_extract(_c(uri), pattern, i), F.lit(""))
    return {"authority": part(1), "namespace": part(2), "entity": F.regexp_extract(_c(uri), pattern, 3)}


def relativize(base: Column | str, uri: Column | str) -> Column:
    """``uri`` as seen from ``base``: whole if its authority is another one, else without authority, and without namespace if that is the same."""
    b, u = reference_parts(base), reference_parts(uri)
    other = u["authority"].isNotNull() & ~u["authority"].eqNullSafe(b["authority"])
    abroad = u["namespace"].isNotNull() & ~u["namespace"].eqNullSafe(b["namespace"])
    return F.when(other, _c(uri)).when(abroad, F.concat(F.lit("/"), u["namespace"], F.lit("/"), u["entity"])).otherwise(u["entity"])


def derelativize(base: Column | str, uri: Column | str) -> Column:
    """``uri`` with the namespace of ``base`` if it has none; a primitive such as /int stays."""
    u = reference_parts(uri)
    bare = u["namespace"].isNull() & ~F.startswith(_c(uri), F.lit("/"))
    return F.when(bare, F.concat(F.lit("/"), reference_parts(base)["namespace"], F.lit("/"), u["entity"])).otherwise(_c(uri))


def resolve(base: Column | str, uri: Column | str, scheme: str = SCHEME) -> Column:
    """``uri`` read from ``base``: whole references stay, rooted ones take scheme and authority, others also the folder."""
    b, u = _c(base), _c(uri)
    root = F.regexp_extract(b, rf"^((?:{scheme}:)?(?://[^/]*)?)", 1)
    folder = F.regexp_extract(b, r"^(.*/)", 1)
    return F.when(u.rlike(rf"^(?:{scheme}:|//)"), u).when(F.startswith(u, F.lit("/")), F.concat(root, u)).otherwise(F.concat(folder, u))


def _types(uri: Column, change) -> Column:
    """``uri`` with its argument types and its return type changed; types stand percent-encoded."""
    pattern = r"^([^(]*\()([^)]*)(\))(.*)$"
    part = lambda i: F.regexp_extract(uri, pattern, i)
    one = lambda x: percent_encode_args(change(percent_decode(x)))
    args = F.when(part(2) == "", F.lit("")).otherwise(F.array_join(F.transform(F.split(part(2), ","), one), ","))
    return F.when(uri.rlike(pattern), F.concat(part(1), args, part(3), one(part(4)))).otherwise(uri)


def canonicalize(uri: Column | str) -> Column:
    """A callable's URI whose types are relative to it."""
    return _types(_c(uri), lambda x: relativize(uri, x))


def decanonicalize(uri: Column | str) -> Column:
    """The inverse of canonicalize."""
    return _types(_c(uri), lambda x: derelativize(uri, x))


def purl_parts(purl: Column | str) -> dict[str, Column]:
    """type, namespace, name, version and ecosystem of pkg:type/namespace/name@version?qualifiers#subpath."""
    pattern = r"^pkg:([^/]+)/(?:(.+)/)?([^/@?#]+)(?:@([^?#]*))?(?:\?[^#]*)?(?:#.*)?$"
    part = lambda i: F.nullif(percent_decode(F.regexp_extract(_c(purl), pattern, i)), F.lit(""))
    known = F.create_map(*[F.lit(x) for kv in ECOSYSTEMS.items() for x in kv])
    return {"type": part(1), "namespace": part(2), "name": part(3), "version": part(4), "ecosystem": F.try_element_at(known, part(1))}


def purl_package(purl: Column | str) -> Column:
    """Package name as the tables hold it: namespace:name for Maven, the name alone otherwise."""
    p = purl_parts(purl)
    return F.when(p["type"] == "maven", F.concat_ws(":", p["namespace"], p["name"])).otherwise(p["name"])


def artifact_url(repository: Column | str, coordinate: Column | str, packaging: str = "jar") -> Column:
    """repository/group/artifact/version/artifact-version.packaging of group:artifact:version."""
    g, a, v = (F.split_part(_c(coordinate), F.lit(":"), F.lit(i)) for i in (1, 2, 3))
    return F.concat(F.regexp_replace(_c(repository), "/+$", ""), F.lit("/"), F.replace(g, F.lit("."), F.lit("/")), F.lit("/"), a, F.lit("/"), v, F.lit("/"), a, F.lit("-"), v, F.lit("." + packaging))


def file_name(text: Column | str) -> Column:
    """Characters that are unsafe in file names replaced by '-'."""
    return F.regexp_replace(_c(text), r"[^a-zA-Z0-9._\-]", "-")


def callable_name(path: Column | str) -> Column:
    """A::B::m as A$B.m( ; a constructor, whose last two parts are equal, ends in <init>( ."""
    parts = F.split(_c(path), "::")
    owner = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "$")
    last = F.element_at(parts, -1)
    method = F.when((F.size(parts) > 1) & (last == F.try_element_at(parts, F.lit(-2))), F.lit("<init>")).otherwise(last)
    return F.when(F.size(parts) == 1, F.concat(last, F.lit("("))).otherwise(F.concat(owner, F.lit("."), method, F.lit("(")))


def epoch_millis(ts: Column | str) -> Column:
    """Epoch of unknown unit in milliseconds: -1 is null, values within the first year of milliseconds are seconds."""
    t = _c(ts)
    return F.when(t == -1, None).when(F.floor(t / 31_536_000_000) < 1, t * 1000).otherwise(t)
