from __future__ import annotations

from wardline.llm import line_rules as R

PROSE = "This is a plain line of text, with some words and a full stop at its end.\n"


def rows(spark, texts, extra="cleaned string, n_words int"):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], f"doc_id long, text string, {extra}")
    return {r["doc_id"]: r for r in R.clean(df).collect()}


def brute(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(wins) if wins.count(w) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\f\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_base_measures(spark):
    texts = [None, "", " \n\t", "a", "a b", "a b c a b c", "x x x x", "a b c d a b c e b c d", PROSE * 3, "ü|é #\n\nü|é #\x0bz", "a b c\na b c d"]
    got = rows(spark, texts)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [tuple(got[i][n] for n in names) for i in range(len(texts))] == [brute(t) for t in texts]


def test_verdicts(spark):
    body = "".join(f"a{i} b{i} c{i} d{i}, e{i} and f{i} g{i} h{i}.\n" for i in range(12))
    menu = "Home | About | News | Contact | Shop | Help\n"
    noise = "".join(f"w{i}*** x{i}### y{i}$$$ z{i}%%%\n" for i in range(30))
    shout = "".join(f"BUY{i}!! NOW{i}!! CHEAP{i}!! THINGS{i}!! HERE{i}!! GO{i}!!\n" for i in range(30))
    flat = " ".join(f"word{i}" for i in range(300))
    got = rows(spark, [body, menu + body + "All rights reserved.", menu * 40, noise, shout, flat, "short."])
    assert [got[i]["kept"] for i in range(7)] == [True, True, False, False, False, False, False]
    assert got[1]["cleaned"] == body.rstrip("\n") and got[1]["n_lost_chars"] == len(menu) - 1 + len("All rights reserved.")
    assert got[6]["base_failed"] and not got[3]["base_failed"]


def test_clean_documents_stay(spark):
    article = " ".join(f"Sentence {i} tells of tree {i} and river {i}." for i in range(60)) + " To read on, log in to the library."
    hindi = "\n".join(" ".join(f"शब्द{i}{k}" for k in range(14)) + " है।" for i in range(12))
    chinese = "\n".join(" ".join(f"词{i}{k}" for k in range(14)) + "。" for i in range(12))
    urdu = "\n".join(" ".join(f"لفظ{i}{k}" for k in range(14)) + "۔" for i in range(12))
    got = rows(spark, [article, hindi, chinese, urdu])
    assert all(got[i]["kept"] and got[i]["n_lost_chars"] == 0 for i in range(4))
    menu = rows(spark, ["Click here to log in to your account\n" + article])[0]
    assert menu["kept"] and menu["n_lost_chars"] == len("Click here to log in to your account")


def test_long_and_repeated_texts(spark):
    texts = ["a " * 300_000, "x" * 1_000_000, "\n" * 300_000, "| " * 200_000]
    got = rows(spark, texts)
    assert got[0]["n_repeat_words"] == 300_000 and got[1]["n_words"] == 1 and got[2]["n_words"] == 0


def test_empty_table(spark):
    assert R.clean(spark.createDataFrame([], "doc_id long, text string")).count() == 0
