import hashlib
import random
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from estatelens.llm import mojibake
from estatelens.llm.mojibake import EAST_PAGES, SWAPS, affected, contexts, further_pages, learn, readings, restored, undo

WORDS = {
    "de": "Gehäuse Führungsschiene Düse Wärmeübertrager größer Öffnung Träger für gleichmäßig Kräfte Lösung über Prüfung".split(),
    "fr": "procédé élément réglage boîtier à façon clapet entrée pièce réservoir étanchéité où dès".split(),
    "ru": "устройство поршень клапан вал корпус ротор сопло датчик способ рычаг световод".split(),
    "pl": "zawór obudowa wał napędowy sprężyna pierścień łożyska układ sterujący ciśnienie żeby".split(),
    "en": "the valve – housing ≤ 5 µm and “rotor” of 20 °C is set".split(),
}


def sentence(rnd, lang):
    return " ".join(rnd.choice(WORDS[lang]) for _ in range(rnd.randint(6, 14))) + "."


def garble(text, page):
    out = []
    for b in text.encode("utf-8"):
        try:
            out.append(bytes([b]).decode(page))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def corpus():
    rnd = random.Random(11)
    docs, truth = [], {}
    for i in range(700):
        lang = rnd.choice(list(WORDS))
        parts = [sentence(rnd, lang) for _ in range(8)]
        text, source = "\n".join(parts), rnd.choice(["s1", "s2", None])
        if i % 10 == 3:
            page = rnd.choice(["cp1252", "cp437", "cp850", "latin-1", "mac_roman"] if lang != "ru" else ["cp1252", "cp1251"])
            how = rnd.choice(["whole", "stretch", "twice"])
            bad = list(parts)
            k = rnd.randrange(8)
            if how == "stretch":
                bad[k] = garble(bad[k], page)
            else:
                bad = [garble(x, page) for x in bad]
                if how == "twice" and page in ("cp1252", "latin-1"):
                    bad = [garble(x, page) for x in bad]
            garbled = "\n".join(bad)
            if garbled != text:
                truth[i] = hashlib.sha256(text.encode()).hexdigest()
                text = garbled
        elif i % 50 == 7:
            text = text.encode("ascii", "replace").decode().replace("?", "�")
            if "�" in text:
                truth[i] = ""
        elif i % 50 == 8:
            text += '\nTable 4 lists the wrong forms "Ã¤", "Ã¶" and "Ã¼".\nIt shows "Ã©" instead of "é".'
        docs.append((i, text, source, "clash"))
    docs += [(10_000, None, "s1", ""), (10_001, "", "s1", ""), (10_002, "plain ascii " * 2000, None, ""), (10_003, "&eacute; and □□ = 3", "s1", ""), (10_003, "&eacute;", "s1", "")]
    return docs, truth


SCHEMA = "doc_id bigint, text string, source string, restored string"


def test_found_and_restored(spark):
    docs, truth = corpus()
    got = {r["doc_id"]: r["restored_sha256"] for r in affected(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert set(got) - set(truth) == set()
    right = sum(got.get(i) == h for i, h in truth.items())
    assert right / len(truth) > 0.97, (right, len(truth))


def test_single_byte_swap(spark):
    rnd = random.Random(2)
    docs = [(i, "\n".join(sentence(rnd, rnd.choice(["ru", "de"])) for _ in range(6)), "s") for i in range(200)]
    plain = "\n".join(sentence(rnd, "ru") for _ in range(12))
    docs.append((999, plain.encode("cp1251").decode("cp1252"), "s"))
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    assert [(r["doc_id"], r["restored"]) for r in restored(df, learn(df)).collect()] == [(999, plain)]


def clean(rnd, n=300, source="s1"):
    return [(i, "\n".join(sentence(rnd, rnd.choice(list(WORDS))) for _ in range(6)), source) for i in range(n)]


def restored_share(spark, docs, truth):
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r["restored"] for r in restored(df, learn(df)).collect()}
    assert set(got) <= set(truth), sorted(set(got) - set(truth))
    return sum(got.get(i) == t for i, t in truth.items()) / len(truth)


@pytest.mark.parametrize("page, langs", [("iso8859_7", ("de", "fr")), ("cp1257", ("de", "fr")), ("gbk", ("de", "fr", "ru")), ("cp932", ("de",)), ("cp949", ("de", "fr"))])
def test_pages_beyond_the_common_ones(spark, page, langs):
    rnd = random.Random(21)
    docs, truth = clean(rnd, 500), {}
    for i in range(1000, 1020):
        text = "\n".join(sentence(rnd, rnd.choice(langs)) for _ in range(6))
        try:
            docs.append((i, text.encode("utf-8").decode(page) if page in EAST_PAGES else garble(text, page), f"s{i % 2}"))
        except UnicodeDecodeError:
            continue
        truth[i] = text
    assert len(truth) >= 10 and restored_share(spark, docs, truth) >= 0.9


def test_many_times_and_mixed_chains(spark):
    rnd = random.Random(22)
    docs, truth = clean(rnd), {}
    for i in range(1000, 1030):
        text = "\n".join(sentence(rnd, rnd.choice(["de", "fr"])) for _ in range(4))
        garbled = text
        for page in (["latin-1"] * 4 if i % 3 == 0 else ["latin-1"] * 6 if i % 3 == 1 else ["cp437", "latin-1", "cp850"]):
            garbled = garble(garbled, page)
        docs.append((i, garbled, "s2"))
        truth[i] = text
    assert restored_share(spark, docs, truth) >= 0.95
    ru = "\n".join(sentence(rnd, "ru") for _ in range(8))
    swapped = garble(ru.encode("cp1251").decode("cp1252"), "latin-1")  # a swap of pages, then UTF-8 read wrongly
    assert restored_share(spark, [*clean(rnd), (2000, swapped, "s1")], {2000: ru}) == 1.0


def test_page_that_nobody_knows(spark):
    """UTF-8 read as a page made for this test: its letters are learned from the corpus."""
    rnd = random.Random(23)
    letters = [chr(c) for c in range(0x0531, 0x0587) if chr(c).isalpha()] + [chr(c) for c in range(0x10A0, 0x10FF) if chr(c).isalpha()]
    page = rnd.sample(letters, 128)
    docs, truth = clean(rnd, 600), {}
    for i in range(1000, 1080):
        text = "\n".join(sentence(rnd, rnd.choice(["de", "fr", "pl"])) for _ in range(6))
        docs.append((i, "".join(chr(b) if b < 128 else page[b - 128] for b in text.encode("utf-8")), "odd"))
        truth[i] = text
    # a source with real words in the same letters, and one with formulas
    docs += [(3000 + i, " ".join("".join(rnd.choice(letters[:38]) for _ in range(rnd.randint(2, 9))) for _ in range(12)), "armenian") for i in range(60)]
    docs += [(4000 + i, "set α = 5 and Δβ of ρφ is used", "formulas") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    model = learn(df)
    assert len(model.tables) == 1
    got = {r["doc_id"]: r["restored"] for r in restored(df, model).collect()}
    assert set(got) <= set(truth)
    own = [(a, b) for i, t in truth.items() for a, b in zip(t, got.get(i, "\uffff" * len(t))) if a > "\x7f"]
    assert sum(a == b for a, b in own) / len(own) > 0.9, sum(a == b for a, b in own) / len(own)


def test_steps():
    assert undo("Ã¤", ("utf8", "cp1252")) == "ä" and undo("ä", ("utf8", "cp1252")) is None and undo("├ñ", ("utf8", "cp437")) == "ä"
    assert undo("ðîòîð", ("cp1252", "cp1251")) == "ротор" and all(undo("漢", s) is None for s in SWAPS)
    assert dict(readings(garble(garble("ß", "latin-1"), "latin-1")))["ß"]


def test_empty(spark):
    assert affected(spark.createDataFrame([], SCHEMA)).count() == 0
    assert affected(spark.createDataFrame([(1, None, None, ""), (2, "", None, "")], SCHEMA)).count() == 0


def test_readings_of_every_page():
    for page in further_pages():
        for letter in "äéßП":
            garbled = garble(letter, page)
            if len(garbled) == 2 and garbled.encode("utf-8", "replace") and all(c > "\x7f" for c in garbled):
                assert dict(readings(garbled)), (page, letter)
    text = "ä"
    for _ in range(7):
        text = garble(text, "latin-1")
    assert "ä" in dict(readings(text)) and contexts("aÃ¤b") == ["aÃ¤b"]


def test_runs_of_many_texts_at_once():
    rnd = random.Random(5)
    letters = ["\n", "a", '"', "é", "Ã", "¤", "漢", "Ａ", "ﾊ", "가", "ᄀ", "п", "\ufffd", "\uffff", "😀", " ", "–", "\x80"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 20))) for _ in range(500)]
    around, at = mojibake.contexts_of(texts)
    assert [around[a:b] for a, b in pairwise(at)] == [contexts(t) for t in texts]
    assert mojibake.contexts_of([]) == ([], [0]) and mojibake.contexts_of(["", ""]) == ([], [0, 0, 0])


def small_model(texts):
    found = Counter(c for t in texts for c in contexts(t))
    return mojibake.Model(*mojibake._counted(list(found), list(found.values())), {0: {(("utf8", "cp1252"),): 0.05}})


def test_many_runs_at_once_are_measured_like_single_ones(monkeypatch):
    texts = [t for _, t, _ in clean(random.Random(6), 60)]
    model, around = small_model(texts), [c for t in texts[:9] for c in contexts(garble(t, "cp1252"))]
    around += [c for t in texts[:9] for c in contexts(t)] + ["a漢字b", "\n😀\n"]
    monkeypatch.setattr(mojibake, "CHUNK", 40)
    assert model.likelihoods(around) == [model.likelihood(c) for c in around] and model.rarities(around) == [model.rarity(c) for c in around]
    found = model.found(around)
    assert set(found) == set(around) and any(found.values())
    assert all(gain == model.gain(c, text) == model.forced(c, cipher) for c, some in found.items() for cipher, text, gain in some)
    assert model.found([]) == {} and model.likelihoods([]) == model.rarities([]) == [] and not mojibake._counted([], [])[0].any()


def test_equal_runs_are_undone_once(monkeypatch):
    """A text of many equal runs asks for each of them once, not wherever it stands."""
    texts = [t for _, t, _ in clean(random.Random(7), 60)]
    text = "\n".join([garble("größer für Öffnung – 5 µm", "cp1252") + " ... ≤ … ж"] * 300)
    model, asked, forced = small_model(texts), [], mojibake.Model.forced
    monkeypatch.setattr(mojibake.Model, "forced", lambda self, context, cipher: asked.append((context, cipher)) or forced(self, context, cipher))
    assert mojibake.restore(text, 0, model).startswith("größer für Öffnung – 5 µm")
    assert asked and len(asked) == len(set(asked))


def test_a_context_is_in_one_task(spark):
    """What runs can have been is worked out once for all sources, as their rows are in one partition."""
    docs = [(i, t, f"s{i % 7}") for i, t, _ in clean(random.Random(8), 140)]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counted = mojibake.count_runs(spark.createDataFrame(docs, "doc_id bigint, text string, source string"))
        rows = counted.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    tasks = {}
    for r in rows:
        tasks.setdefault(r["context"], set()).add(r["task"])
    assert len({t for own in tasks.values() for t in own}) > 1 and all(len(own) == 1 for own in tasks.values())
    assert sum(r["n"] for r in rows) == sum(len(contexts(t)) for _, t, _ in docs)
    parts = (np.zeros(mojibake.BIGRAMS), np.zeros(mojibake.LETTERS), {})
    assert mojibake._model(parts) is mojibake._model(parts)
