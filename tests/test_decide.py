from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from scrivener.operators import decide, rules
from scrivener.sources import vocabulary

GOLDEN = {
    "teh": "the", "adn": "and", "recieve": "receive", "becuase": "because", "thier": "their",
    **dict.fromkeys(["form", "their", "its", "lead", "to", "nmap", "CVE-2024-1234", "/etc/passwd", "camelCaseIdentifier", "snake_case_identifier", "https://example.com", "user@example.com", "Teh", "don't"]),
}
SUGGESTED = {"reciept": "receipt", "adress": "address", "corection": "correction", "speling": "spelling"}


def decided(spark, words, **more):
    return {r["token"]: r for r in decide.decisions(spark.createDataFrame([(w,) for w in words], "token string"), **more).collect()}


def dictionary(spark, rows):
    return spark.createDataFrame([(k, w, f, 0) for k, (w, f) in enumerate(rows)], vocabulary.SCHEMA)


def test_golden(spark):
    found = decided(spark, [*GOLDEN, *SUGGESTED, "zzzzword", ""])
    for token, replacement in GOLDEN.items():
        assert found[token]["action"] == ("auto_correct" if replacement else "do_nothing") and found[token]["replacement"] == replacement
    assert (found["teh"]["confidence"], found["teh"]["mark"], found["teh"]["reason_codes"]) == (0.99, "blue_applied_correction", ["COMMON_TYPO_MATCH"])
    for token, word in SUGGESTED.items():
        assert found[token]["suggestions"][0] == word and found[token]["reason_codes"] == ["UNKNOWN_NON_WORD", "EDIT_DISTANCE_SUGGESTIONS"]
    assert (found["zzzzword"]["suggestions"], found["zzzzword"]["reason_codes"], found["zzzzword"]["mark"]) == ([], ["UNKNOWN_NON_WORD", "NO_SUGGESTIONS"], "red_spelling_issue")
    assert found[""]["reason_codes"] == ["INVALID_INPUT"] and found["don't"]["reason_codes"] == ["PROTECTED_LOOKING_TOKEN"]


def test_other_languages_are_left_alone(spark):
    assert decided(spark, ["teh"], language="de-DE")["teh"]["reason_codes"] == ["UNSUPPORTED_LANGUAGE"]


def test_loaded_words_win_and_rank(spark):
    loaded = dictionary(spark, [("abb", 10), ("abc", 100), ("the", 5)])
    found = decided(spark, ["aba", "the", "abc"], dictionary=loaded)
    assert found["aba"]["suggestions"][:2] == ["abc", "abb"]
    assert found["the"]["reason_codes"] == ["DYNAMIC_DICTIONARY_MATCH"]


def test_memory_precedence(spark):
    log = spark.createDataFrame([("OMW", "on my way", "always", 1, 1), ("teh", "the", "never", 2, 2), ("adn", "AND", "always", 3, 3)], rules.RULES)
    found = decided(spark, ["omw", "teh", "adn", "acme", "thier"], personal=spark.createDataFrame([(" Acme", 1)], rules.WORDS), rules=log)
    assert (found["omw"]["replacement"], found["omw"]["confidence"]) == ("on my way", 1.0)
    assert found["teh"]["action"] == "mark_unresolved" and found["teh"]["suggestions"][0] == "the" and found["teh"]["reason_codes"] == ["COMMON_TYPO_MATCH", "NEVER_CORRECT_RULE"]
    assert found["adn"]["replacement"] == "AND" and found["thier"]["replacement"] == "their"
    assert found["acme"]["reason_codes"] == ["PERSONAL_DICTIONARY_MATCH"]


def test_cap_comes_before_rank(spark):
    many = [("a" + chr(97 + k // 26) + chr(97 + k % 26) + "z", 1) for k in range(300)] + [("xyzz", 1000)]
    asked = spark.createDataFrame([("xyzq",), ("aaaa",)], "token string")
    words = decide.vocabulary(spark, dictionary(spark, many))
    found = decide.suggestions(asked, words, len(many) + decide.SCANNED, most=99).collect()
    assert [r["word"] for r in found if r["token"] == "xyzq"][0] == "xyzz"
    assert max(r["rank"] for r in found if r["token"] == "aaaa") == 8
    assert {r["rank"] for r in decide.suggestions(asked, words, 400, most=0).collect()} == {1}


def test_both_joins_agree(spark):
    words = decide.vocabulary(spark, dictionary(spark, [(w, 1) for w in ("alpha", "beta", "gamma", "alpine", "a", "ab", "delta")]))
    asked = spark.createDataFrame([(t,) for t in ("alpa", "bta", "b", "deltas", "gama", "zzz", "alphine", "a")], "token string")
    rows = lambda size: sorted((r["token"], r["word"], r["distance"]) for r in decide.fuzzy_pairs(asked, words, size).collect())
    assert rows(decide.SCANNED) == rows(decide.SCANNED + 1) != []


def test_imports_merge_or_replace_all_three_parts(spark):
    body = '{"version": 1, "exportedAt": "2024-01-01T00:00:00Z", "personalDictionary": [{"word": "New "}, {"word": "old", "createdAt": 9}], "correctionRules": [{"original": "A", "replacement": "b", "status": "always", "createdAt": 1}], "settings": {"theme": "dark", "size": 3}}'
    documents = spark.createDataFrame([(body,)], "document string")
    onto = rules.Memory(spark.createDataFrame([("old", 5), ("own", 6)], rules.WORDS), spark.createDataFrame([("a", "c", "always", 0, 0), ("k", "l", "never", 0, 0)], rules.RULES), spark.createDataFrame([("theme", '"light"'), ("lang", '"en"')], "key string, value string"))
    rows = lambda m: [sorted(map(tuple, df.collect())) for df in (m.words, m.rules.select("original", "replacement", "status"), m.settings)]
    replaced, merged = rows(rules.imported(documents, 99)), rows(rules.imported(documents, 99, onto))
    assert replaced == [[("new", 99), ("old", 9)], [("a", "b", "always")], [("size", "3"), ("theme", "dark")]]
    assert merged == [[("new", 99), ("old", 5), ("own", 6)], [("a", "b", "always"), ("k", "l", "never")], [("lang", '"en"'), ("size", "3"), ("theme", "dark")]]
    for bad in ('{"word": " "}', "{}"):
        with pytest.raises(Exception, match="not an export"):
            rules.imported(spark.createDataFrame([(body.replace('{"word": "New "}', bad),)], "document string"), 1).words.collect()


@pytest.mark.parametrize("now", [99])
def test_memory_round_trip(spark, now):
    words = spark.createDataFrame([("Zoo", 5), ("apple", 1), ("zoo ", 3)], rules.WORDS)
    log = spark.createDataFrame([("teh", "the", "never", 1, 1), ("omw", "a", "always", 2, 2), ("OMW", "b", "always", 3, 4)], rules.RULES)
    state = rules.latest_rules(log)
    assert {(r["original"], r["replacement"], r["created_at"], r["updated_at"]) for r in state.collect()} == {("teh", "the", 1, 1), ("omw", "b", 2, 4)}
    document = rules.exported(rules.own_words(words), state, "2024-01-01T00:00:00Z")
    back = rules.imported(document, now)
    assert sorted(map(tuple, back.words.collect())) == [("apple", 1), ("zoo", 3)] and back.rules.exceptAll(state.select(*back.rules.columns)).count() == 0 and back.settings.count() == 0
    with pytest.raises(Exception, match="not an export"):
        rules.imported(spark.createDataFrame([('{"version": 2}',)], "document string"), now).words.collect()
    assert rules.latest_rules(spark.createDataFrame([("x", "", "always", 1, 1), (" ", "y", "never", 1, 1)], rules.RULES)).count() == 0
    assert rules.rule_for(state, "OMW").first()["replacement"] == "b"
    assert rules.without_rules(state, spark.createDataFrame([("omw", None)], "original string, replacement string")).count() == 1
    assert {k: v.count() for k, v in rules.reset({"a": words, "b": log}, "a").items()} == {"a": 0, "b": 3}


def test_long_replacements_are_cut_and_say_so(spark, monkeypatch):
    from scrivener.functions.reasons import codes

    monkeypatch.setattr(decide, "typos", lambda spark: spark.createDataFrame([("abcd", "x" * 200), ("abce", "ok")], "typo string, replacement string"))
    long = "longword" * 4 + "ab"
    dictionary = spark.createDataFrame([(0, long, 5, 0)], "load_order int, word string, frequency long, flags long")
    found = {r["token"]: (r["replacement"], r["reasons"]) for r in decide.checked(spark.createDataFrame([("abcd",), ("abce",), (long[:-1],)], "token string"), dictionary).withColumn("reasons", codes(F.col("flags"))).collect()}
    assert found["abcd"] == ("x" * 127, ["COMMON_TYPO_MATCH", "REPLACEMENT_TRUNCATED"]) and found["abce"] == ("ok", ["COMMON_TYPO_MATCH"])
    assert found[long[:-1]] == (None, ["UNKNOWN_NON_WORD", "REPLACEMENT_TRUNCATED", "EDIT_DISTANCE_SUGGESTIONS"])
