"""The site of a URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def site_of(url: Column) -> Column:
    """Host of a URL, lower case, without user, port, one leading www. and a final dot; '' where there is none.

    A host keeps every other subdomain. The scheme may be spelled in any case or be absent before //.
    """
    authority = F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#\\]*)", 1)
    host = F.lower(F.regexp_extract(authority, r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1))
    return F.coalesce(F.regexp_replace(F.regexp_replace(host, r"\.$", ""), r"^www\.", ""), F.lit(""))
