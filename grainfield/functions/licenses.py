"""Licence detection in URLs and texts, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainfield import rules


def _first(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    out = F.when(text.contains(pairs[0][0]), pairs[0][1])
    for sub, kind in pairs[1:]:
        out = out.when(text.contains(sub), kind)
    return out


def share_alike(url: Column) -> Column:
    return _first(F.lower(url), rules.LICENSE_URLS)


def public_domain(url: Column) -> Column:
    return _first(F.lower(url), rules.PUBLIC_DOMAIN_URLS)


def license_of_url(url: Column) -> Column:
    """Share-alike licence of a URL, else its public-domain mark, else null."""
    return F.coalesce(share_alike(url), public_domain(url))


def license_of_footer(text: Column) -> Column:
    """Licence named in a footer link's text, else null."""
    return _first(F.upper(F.trim(text)), tuple((n, k) for n, _, k in rules.FOOTER_NAMES))


def license_of_text(text: Column) -> Column:
    """SPDX id by the words of a licence text, '' where none is accepted.

    The order decides: a text of an older GPL or LGPL ends the search, and a lesser licence that quotes the general one counts as that.
    """
    t = F.lower(F.coalesce(text, F.lit("")))
    third = t.contains("version 3")
    return (
        F.when(t.contains("gnu affero general public license"), "AGPL-3.0")
        .when(t.contains("gnu general public license"), F.when(third, "GPL-3.0").otherwise(""))
        .when(t.contains("gnu lesser general public license"), F.when(third, "LGPL-3.0").otherwise(""))
        .when(t.contains("mozilla public license"), "MPL-2.0")
        .when(t.contains("creative commons") & t.contains("sharealike"), "CC-BY-SA-4.0")
        .when(t.contains("creative commons") & t.contains("cc0"), "CC0-1.0")
        .when(t.contains("unlicense") | (t.contains("public domain") & ~t.contains("not public domain")), "Unlicense")
        .otherwise("")
    )


def spdx_accepted(spdx: Column, ids: Sequence[str] = rules.SPDX_ACCEPTED) -> Column:
    """Whether an SPDX id is an accepted one, spelled as it is; false for null."""
    return F.coalesce(spdx.isin(*ids), F.lit(False))


def archive_license(name: Column) -> Column:
    """struct<type, url> of an archive's licence id, else null."""
    out = None
    for key, kind, url in rules.ARCHIVE_LICENSES:
        value = F.struct(F.lit(kind).alias("type"), F.lit(url).alias("url"))
        out = F.when(name == key, value) if out is None else out.when(name == key, value)
    return out
