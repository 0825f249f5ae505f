"""Heads of documents in any script, against plain Python."""

import hashlib
import re

from grainfield.functions import texts
from grainfield.plans import catalog
from tests.test_functions import column

#: All characters of the property White_Space.
SPACE = re.compile("[" + "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]+")


def head(text):
    words = [w for w in SPACE.split(text or "") if w]
    return hashlib.md5(" ".join(words[:500]).encode()).hexdigest()


def snippet(text):
    raw = (text or "").encode()
    return text if len(raw) <= 200 else raw[:200].decode(errors="ignore") + "..."


def test_cut_never_parts_a_character_nor_loses_one(spark):
    made = [x * 70 + y for x in ("�", "é", "€", "😀", "a€", "ab😀", "aé�") for y in ("", "z", "�")] + ["b" * 197 + "�" * 9, None, ""]
    assert column(spark, made, texts.snippet) == [snippet(x) for x in made]
    for n in (1, 2, 3, 4, 5):
        assert column(spark, ["😀€", "€é", "é�"], lambda x, n=n: texts.byte_prefix(x, n)) == [x.encode()[:n].decode(errors="ignore") for x in ("😀€", "€é", "é�")]


def test_words_of_any_script(spark):
    made = ["\u3000é\u2003ß\xa0\u1680漢 字\u2028x\x85y", "é " * 600, None, ""]
    got = column(spark, made, texts.first_words)
    assert [hashlib.md5(x.encode()).hexdigest() for x in got] == [head(x) for x in made]


def test_every_document_has_its_head_and_snippet(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    assert any(x and not x.isascii() for x in docs.values())
    assert {r.doc_id: r.head for r in catalog.QUERIES["first_500_words_all"](spark, "/root/testdata/sf0.01").collect()} == {k: head(x) for k, x in docs.items()}
    assert {r.doc_id: r.snippet for r in catalog.QUERIES["snippets_all"](spark, "/root/testdata/sf0.01").collect()} == {k: snippet(x) for k, x in docs.items()}
