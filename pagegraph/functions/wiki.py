"""Wiki addresses: hosts, domains, groups, page URLs, interwiki links and wiki tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegraph.functions import fixed
from pagegraph.functions.text import (
    after_first,
    before_first,
    before_slash,
    bytes_title,
    let,
    map_value,
    named,
    page_title,
    quote,
    strip,
    unquote,
    user_name,
)


def clean_host(host: Column) -> Column:
    return F.rtrim(F.lower(strip(F.coalesce(host, F.lit("")))), F.lit("."))


def host_valid(host: Column) -> Column:
    """At least two labels of letters, digits and inner hyphens; at most 253 characters."""
    text = clean_host(host)
    labels = F.split(text, r"\.")
    return (
        (F.length(text) <= 253)
        & (F.size(labels) >= 2)
        & F.forall(labels, lambda label: label.rlike(fixed.HOST_LABEL_PATTERN))
    )


def short_code_valid(code: Column) -> Column:
    return F.lower(strip(F.coalesce(code, F.lit("")))).rlike(fixed.HOST_LABEL_PATTERN)


def site_domain(site: Column) -> Column:
    """Domain of a database-style site token (``enwiki``); null when it is not one."""
    return token_site_domain(F.lower(strip(F.coalesce(site, F.lit("")))))


def token_site_domain(token: Column) -> Column:
    """As :func:`site_domain`, for a token that is already lower case and stripped."""
    by_suffix = F.lit(None).cast("string")
    for suffix, domain in reversed(fixed.SITE_SUFFIX_DOMAINS.items()):
        lang = F.replace(F.substring(token, F.lit(1), F.length(token) - len(suffix)), F.lit("_"), F.lit("-"))
        ok = lang.rlike(fixed.HOST_LABEL_PATTERN)
        host = F.when(ok, F.concat(lang, F.lit("." + domain)))
        by_suffix = F.when(F.endswith(token, F.lit(suffix)), host).otherwise(by_suffix)
    special = map_value(fixed.SPECIAL_SITES, token)
    return F.when(token.rlike(fixed.SITE_TOKEN_PATTERN), F.coalesce(special, by_suffix))


def site_group(site: Column) -> Column:
    """Wiki group of a site token; an unknown token is its own group."""
    token = F.lower(strip(F.coalesce(site, F.lit(""))))
    out = F.when(token == "", F.lit("wikimedia")).otherwise(token)
    for suffix, group in reversed(fixed.SITE_SUFFIX_GROUPS.items()):
        out = F.when(F.endswith(token, F.lit(suffix)), F.lit(group)).otherwise(out)
    return F.coalesce(map_value(fixed.SITE_TOKEN_GROUPS, token), out)


def code_group(code: Column) -> Column:
    """Wiki group of a site-matrix code; an unknown code is its own group."""
    key = F.lower(strip(F.coalesce(code, F.lit(""))))
    return F.coalesce(map_value(fixed.SITE_CODE_GROUPS, key), F.nullif(key, F.lit("")), F.lit("wikimedia"))


def site_root(url: Column) -> Column:
    """struct<domain, site_url> of a http(s) or scheme-less URL with a valid host, else null."""
    text = strip(url)
    scheme = F.lower(F.nullif(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.lit("")))
    host = url_host(text)
    scheme = F.coalesce(scheme, F.lit("https"))
    ok = host_valid(host) & scheme.isin("http", "https")
    return F.when(ok, F.struct(host.alias("domain"), F.concat(scheme, F.lit("://"), host, F.lit("/")).alias("site_url")))


def url_host(url: Column) -> Column:
    """Lower-case host of ``scheme://…`` or ``//…``; null when there is none."""
    authority = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", "")
    return F.nullif(F.lower(strip(host)), F.lit(""))


def page_from_url(url: Column) -> Column:
    """struct<domain, title> of a wiki page URL (``/wiki/…`` or the last ``title=``), else null."""
    text = strip(url)
    host = url_host(F.when(text.rlike(r"^(?i)https?://"), text))
    path = F.regexp_extract(text, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(text, r"^[^?#]*\?([^#]*)", 1)
    values = F.filter(
        F.transform(
            F.filter(F.split(query, "&"), lambda part: F.startswith(part, F.lit("title="))),
            lambda part: strip(unquote(F.replace(F.substring(part, F.lit(7), F.length(part)), F.lit("+"), F.lit(" ")))),
        ),
        lambda value: value != "",
    )
    in_path = F.startswith(path, F.lit("/wiki/"))
    raw = F.when(in_path, unquote(F.substring(path, F.lit(7), F.length(path)))).otherwise(unquote(F.try_element_at(values, F.lit(-1))))
    title = page_title(raw)
    return F.when(host_valid(host) & (title != ""), F.struct(host.alias("domain"), title.alias("title")))


def full_title(title: Column, namespace: Column, namespace_name: Column) -> Column:
    """Title with its namespace name in front, for namespaces above 0 that have one."""
    name = strip(F.coalesce(namespace_name, F.lit("")))
    core = bytes_title(title)
    prefixed = F.concat(name, F.lit(":"), core)
    return F.when((core != "") & (namespace > 0) & (name != ""), prefixed).otherwise(core)


def article_url(origin: Column, article_path: Column, title: Column, empty_path: str = "/wiki/$1") -> Column:
    """Page URL: the quoted title goes where ``$1`` stands, else after the path."""
    path = F.coalesce(F.nullif(strip(article_path), F.lit("")), F.lit(empty_path))
    path = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))
    quoted = quote(title)
    head = before_first(path, "$1")
    tail = after_first(path, "$1")
    url = F.when(
        F.contains(path, F.lit("$1")), F.concat(origin, head, quoted, F.coalesce(tail, F.lit("")))
    ).otherwise(F.concat(origin, F.rtrim(path, F.lit("/")), F.lit("/"), quoted))
    return F.when(title != "", url)


def page_url(domain: Column, article_path: Column, namespace: Column, namespace_name: Column, title: Column) -> Column:
    return article_url(F.concat(F.lit("https://"), domain), article_path, full_title(title, namespace, namespace_name))


def interwiki_uri(template: Column, title: Column) -> Column:
    """Template with ``$1`` replaced by the quoted title; a template without it is used as is."""
    clean = page_title(title)
    return F.when((F.coalesce(template, F.lit("")) != "") & (clean != ""), F.replace(template, F.lit("$1"), quote(clean)))


def interwiki_url(template: Column, title: Column) -> Column:
    """As :func:`interwiki_uri`, limited to http(s) targets; ``//`` gets https."""
    uri = interwiki_uri(strip(template), title)
    uri = F.when(F.startswith(uri, F.lit("//")), F.concat(F.lit("https:"), uri)).otherwise(uri)
    return F.when(F.startswith(uri, F.lit("http://")) | F.startswith(uri, F.lit("https://")), uri)


def project_parts(title: Column) -> Column:
    """struct<project, lang, name> of ``project/lang/name``; with fewer parts the last is the name."""
    parts = F.split(title, "/", 3)
    part = lambda n: F.coalesce(F.try_element_at(parts, F.lit(n)), F.lit(""))
    return F.struct(part(1).alias("project"), part(2).alias("lang"), part(-1).alias("name"))


def project_group(project: Column) -> Column:
    fallback = F.lower(strip(project))
    return F.coalesce(map_value(fixed.PROJECT_CODE_GROUPS, project), fallback)


def project_title_group(title: Column) -> Column:
    """Wiki group of a ``project/lang/name`` title; a blank project counts as wikimedia."""
    project = project_parts(title)["project"]
    return F.coalesce(F.nullif(project_group(project), F.lit("")), F.lit("wikimedia"))


def project_site_url(base: Column, project: Column, lang: Column) -> Column:
    path = quote(F.concat(strip(project), F.lit("/"), strip(lang), F.lit("/")))
    return F.when((strip(project) != "") & (strip(lang) != ""), F.concat(base, path))


def canonical_token(domain: Column, wiki_group: Column, lang_code: Column) -> Column:
    """Short token of a known wiki: special name, language, ``prefix:lang`` or its domain."""
    lang = F.lower(strip(F.coalesce(lang_code, F.lit(""))))
    prefix = map_value(fixed.GROUP_PREFIXES, wiki_group)
    ok = short_code_valid(lang)
    return F.coalesce(
        map_value(fixed.SPECIAL_DOMAIN_TOKENS, domain),
        F.when((wiki_group == "wikipedia") & ok, lang),
        F.when(prefix.isNotNull() & ok, F.concat(prefix, F.lit(":"), lang)),
        domain,
    )


def _split_token(token: Column) -> tuple[Column, Column, Column]:
    """(group, language, is a well-formed ``prefix:lang`` pair) of a wiki token."""
    parts = F.split(token, ":")
    group = map_value(fixed.PREFIX_GROUPS, strip(F.get(parts, 0)))
    lang = F.lower(strip(F.get(parts, 1)))
    suffix = map_value(fixed.GROUP_DOMAIN_SUFFIXES, group)
    return group, lang, (F.size(parts) == 2) & suffix.isNotNull() & short_code_valid(lang)


def wiki_token(raw: Column) -> Column:
    """Canonical form of a requested wiki token; null when it is not a valid one."""
    token = clean_host(raw)
    group, lang, pair = _split_token(token)
    pair_token = F.when(group == "wikipedia", lang).otherwise(
        F.concat(map_value(fixed.GROUP_PREFIXES, group), F.lit(":"), lang)
    )
    by_host = token
    for name, suffix in reversed(fixed.GROUP_DOMAIN_SUFFIXES.items()):
        code = F.substring(token, F.lit(1), F.length(token) - len(suffix))
        short = code if name == "wikipedia" else F.concat(F.lit(fixed.GROUP_PREFIXES[name] + ":"), code)
        by_host = F.when(F.endswith(token, F.lit(suffix)), F.when(short_code_valid(code), short).otherwise(token)).otherwise(
            by_host
        )
    host_token = F.coalesce(map_value(fixed.SPECIAL_DOMAIN_TOKENS, token), by_host)
    return F.coalesce(
        map_value(fixed.TOKEN_ALIASES, token),
        F.when(host_valid(token), host_token),
        F.when(pair, pair_token),
        F.when(short_code_valid(token), token),
    )


def token_domain(raw: Column) -> Column:
    """Domain a wiki token stands for; text that is no token comes back unchanged."""
    token = clean_host(raw)
    group, lang, pair = _split_token(token)
    host = F.when(token == "wikidata.org", F.lit(fixed.WIKIDATA_DOMAIN)).otherwise(token)
    return F.coalesce(
        map_value(fixed.SPECIAL_TOKEN_DOMAINS, map_value(fixed.TOKEN_ALIASES, token)),
        F.when(host_valid(token), host),
        F.when(pair, F.concat(lang, map_value(fixed.GROUP_DOMAIN_SUFFIXES, group))),
        F.when(short_code_valid(token), F.concat(token, F.lit(".wikipedia.org"))),
        token,
    )


def interwiki_target(prefix: Column, title: Column, source_group: Column, dynamic_domain: Column) -> Column:
    """struct<domain, title> an interwiki link points to, else null.

    ``dynamic_domain`` is the domain of a language-less wiki whose site code equals the prefix.
    """
    return let(
        F.struct(F.lower(strip(prefix)).alias("key"), bytes_title(title).alias("title")),
        lambda link: _target(link["key"], link["title"], source_group, dynamic_domain),
    )


def _target(key: Column, clean: Column, source_group: Column, dynamic_domain: Column) -> Column:
    group = map_value(fixed.PREFIX_GROUPS, key)
    suffix = map_value(fixed.GROUP_DOMAIN_SUFFIXES, group)
    lang = F.lower(strip(before_first(clean, ":")))
    rest = page_title(after_first(clean, ":"))
    pair = lambda d, t: named(domain=d, title=t)
    special = map_value(fixed.PREFIX_SPECIAL_DOMAINS, key)
    in_group = (
        F.when(group == "commons", pair(F.lit(fixed.COMMONS_DOMAIN), clean))
        .when(group == "wikidata", pair(F.lit(fixed.WIKIDATA_DOMAIN), clean))
        .when(suffix.isNotNull() & (lang != "") & (rest != ""), pair(F.concat(lang, suffix), rest))
    )
    own_suffix = map_value(fixed.GROUP_DOMAIN_SUFFIXES, source_group)
    return F.when(
        (key != "") & (clean != ""),
        F.when(special.isNotNull(), pair(special, clean))
        .when(group.isNotNull(), in_group)
        .when(dynamic_domain.isNotNull(), pair(dynamic_domain, clean))
        .when(own_suffix.isNotNull(), pair(F.concat(key, own_suffix), clean)),
    )


def user_page_reference(domain: Column, title: Column, site_code: Column) -> Column:
    """Canonical interwiki reference of a page (``:prefix:lang:Title``); null when unsupported."""
    clean = page_title(title)
    wrap = lambda *parts: F.concat(F.lit(":"), *parts, F.lit(":"), clean)
    by_group = F.lit(None).cast("string")
    for group, suffix in reversed(fixed.GROUP_DOMAIN_SUFFIXES.items()):
        lang = F.substring(domain, F.lit(1), F.length(domain) - len(suffix))
        hit = F.endswith(domain, F.lit(suffix)) & (lang != "")
        by_group = F.when(hit, wrap(F.lit(fixed.GROUP_PREFIXES[group] + ":"), lang)).otherwise(by_group)
    code = F.nullif(F.lower(strip(site_code)), F.lit(""))
    return (
        F.when(domain == fixed.INCUBATOR_DOMAIN, wrap(F.lit("incubator")))
        .when(domain == fixed.META_DOMAIN, wrap(F.lit("meta")))
        .when(domain == fixed.COMMONS_DOMAIN, wrap(F.lit("commons")))
        .when(domain.isin(fixed.WIKIDATA_DOMAIN, "wikidata.org"), wrap(F.lit("d")))
        .otherwise(F.coalesce(by_group, wrap(code)))
    )


def title_from_reference(reference: Column, dynamic_domain: Column) -> Column:
    """struct<domain, title> of a user-list page given as URL or interwiki text, else null."""
    from_url = page_from_url(reference)
    text = strip(F.ltrim(strip(reference), F.lit(":")))
    parts = F.transform(F.split(text, ":"), strip)
    count = F.size(parts)
    prefix = F.lower(F.get(parts, 0))
    tail = lambda n: page_title(F.array_join(F.slice(parts, F.lit(n), F.greatest(count - (n - 1), F.lit(0))), ":"))
    group = map_value(fixed.PREFIX_GROUPS, prefix)
    suffix = map_value(fixed.GROUP_DOMAIN_SUFFIXES, group)
    special = F.coalesce(
        map_value(fixed.PREFIX_SPECIAL_DOMAINS, prefix), F.when(group.isNull(), dynamic_domain)
    )
    lang = F.lower(F.get(parts, 1))
    pair = lambda d, t: F.when(t != "", F.struct(d.alias("domain"), t.alias("title")))
    from_text = F.when(special.isNotNull() & (count >= 2), pair(special, tail(2))).when(
        suffix.isNotNull() & (count >= 3) & (lang != ""), pair(F.concat(lang, suffix), tail(3))
    )
    return F.coalesce(from_url, from_text)


def local_user(title: Column) -> Column:
    """User name of a user-namespace link target: the part before any subpage."""
    return user_name(before_slash(bytes_title(title)))


def namespaced_user(title: Column) -> Column:
    """struct<prefix, user> of ``Prefix:User/subpage``; the prefix still has to be an alias."""
    return let(page_title(title), _prefix_and_user)


def _prefix_and_user(clean: Column) -> Column:
    prefix = F.lower(strip(before_first(clean, ":")))
    user = user_name(before_slash(after_first(clean, ":")))
    return F.when((prefix != "") & user.isNotNull(), named(prefix=prefix, user=user))
