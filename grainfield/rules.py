"""Rule lists as data; every function that uses one takes a list of the caller's instead."""

# Query parameters that track a visitor and do not change a page.
TRACKING_PARAMS = (
    "share", "shared", "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "utm_id", "fbclid", "gclid", "dclid", "msclkid", "yclid", "_ga", "mc_eid", "mc_cid", "_hsenc", "_hsmi", "ref_src",
)

# Values of a wiki's action parameter that serve forms, not articles.
WIKI_ACTIONS = ("edit", "history", "raw", "submit", "info", "delete", "protect", "move", "watch", "purge")

# Path suffixes of files that are not text.
BINARY_SUFFIXES = (
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".bmp", ".ico", ".tiff", ".tif", ".avif", ".mp3", ".mp4", ".wav", ".ogg", ".webm", ".flac", ".avi", ".mov", ".mkv", ".zip", ".tar", ".gz", ".bz2",
    ".xz", ".rar", ".7z", ".exe", ".dll", ".so", ".dylib", ".bin", ".dmg", ".iso", ".deb", ".rpm", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".woff", ".woff2", ".ttf", ".otf", ".eot",
)

# Path prefixes of a wiki's pages about itself.
WIKI_META_PREFIXES = tuple(
    f"/wiki/{x}:" for x in (
        "Category", "Special", "Help", "User", "User_talk", "Talk", "File", "Template", "Template_talk", "Portal", "MediaWiki", "Module", "Draft", "Wikipedia", "Wikipedia_talk", "Wiktionary", "Wikibooks", "Wikisource",
        "Wikivoyage", "Wikiquote", "Wikinews", "Wikiversity", "Wikidata", "Commons", "Meta",
    )
)

# Catalogue pages by path prefix, and wiki projects whose hosts begin with a language.
CATALOGUE_PREFIXES = ("/ebooks/bookshelf/", "/ebooks/subject/")
WIKI_PROJECTS = tuple(f".{x}.org" for x in ("wikipedia", "wikibooks", "wikisource", "wiktionary", "wikiquote", "wikinews", "wikiversity", "wikivoyage"))

# Hosts of code forges, whose pages are known by owner and repository.
FORGES = ("github.com", "codeberg.org")

# Parts of licence URLs, first match wins, any case.
LICENSE_URLS = (
    ("creativecommons.org/licenses/by-sa/", "CC BY-SA"),
    ("gnu.org/licenses/agpl", "AGPL"),
    ("opensource.org/licenses/agpl", "AGPL"),
    ("gnu.org/licenses/lgpl-3", "LGPL"),
    ("opensource.org/licenses/lgpl-3", "LGPL"),
    ("gnu.org/licenses/gpl-3", "GPL-3.0"),
    ("opensource.org/licenses/gpl-3", "GPL-3.0"),
    ("mozilla.org/mpl", "MPL"),
    ("opensource.org/licenses/mpl", "MPL"),
)
PUBLIC_DOMAIN_URLS = (("creativecommons.org/publicdomain/zero/", "CC0"), ("creativecommons.org/publicdomain/mark/", "Public Domain"), ("unlicense.org", "Unlicense"))

# Licence names in a footer's link text, with the licence they stand for.
FOOTER_NAMES = (
    ("CC BY-SA", "https://creativecommons.org/licenses/by-sa/4.0/", "CC BY-SA"),
    ("CC0", "https://creativecommons.org/publicdomain/zero/1.0/", "CC0"),
    ("AGPL", "https://www.gnu.org/licenses/agpl-3.0.html", "AGPL"),
    ("GPL-3", "https://www.gnu.org/licenses/gpl-3.0.html", "GPL-3.0"),
    ("GPLV3", "https://www.gnu.org/licenses/gpl-3.0.html", "GPL-3.0"),
)

# Elements whose text is not content, and elements that are paragraphs.
SKIPPED_TAGS = frozenset("script style nav footer header noscript svg aside".split())
BLOCK_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote dd dt figcaption".split())

# SPDX identifiers of licences that are accepted.
SPDX_ACCEPTED = ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MPL-2.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0", "Unlicense")

# Licence ids of an archive's records, with the licence and its URL.
ARCHIVE_LICENSES = (
    ("cc-by-sa-4.0", "CC BY-SA", "https://creativecommons.org/licenses/by-sa/4.0/"),
    ("cc-by-sa-3.0", "CC BY-SA", "https://creativecommons.org/licenses/by-sa/3.0/"),
    ("cc0-1.0", "CC0", "https://creativecommons.org/publicdomain/zero/1.0/"),
    ("cc-zero", "CC0", "https://creativecommons.org/publicdomain/zero/1.0/"),
)

# Domains by how far their material is known to be good.
DOMAIN_TIERS = (
    ("rfc-editor.org", "bartoszmilewski.com", "math.dartmouth.edu", "gutenberg.org"),
    ("math.libretexts.org", "eng.libretexts.org", "phys.libretexts.org", "nordstrommath.com", "uscode.house.gov", "ecfr.gov"),
    ("pressbooks.pub",),
)
