"""The vocabulary of the scan repair keeps every word that may be a right spelling, or says that it can't."""

import pytest

from grainfield.llm import scan_repair

CLEAN = "the zebra walks where the yellow zinnia grows"
SCAN = "\n".join(f"aaa{a}b aab{a}c aac{a}d aad{a}e aae{a}f aaf{a}g" for a in "klmno")


def test_misreadings_take_no_place_of_words(spark, monkeypatch):
    texts = spark.createDataFrame([(CLEAN, ""), (SCAN, "")], "text string, title string")
    words = set(CLEAN.split())
    assert scan_repair.is_scan(SCAN)
    monkeypatch.setattr(scan_repair, "VOCABULARY", len(words))
    assert set(scan_repair.fit_corrector(texts).counts) == words
    monkeypatch.setattr(scan_repair, "VOCABULARY", len(words) - 1)
    with pytest.raises(ValueError, match="words"):
        scan_repair.fit_corrector(texts)


def test_one_long_line_does_not_stop_a_repair():
    lines = ["The harbour was built in the year of the great storm, and the", "ships that came to it brought tim-", "ber, salt and wool to the merchants of the old town by the sea."] * 5
    assert scan_repair.is_scan("\n".join(lines))
    assert scan_repair.is_scan("\n".join([*lines, "word " * 60]))
    assert not scan_repair.is_scan("\n".join(["word " * 60] * 6))
    assert not scan_repair.is_scan("a short note")
