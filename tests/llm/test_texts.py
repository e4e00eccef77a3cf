import collections
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import distinctive, encodings, languages, mixing, sentences, tokens

from ..conftest import rows

# wrong encodings

SPANISH = "corazón canción mañana niño después jardín pájaro último también árbol música está allá días años señal según lección unión así ñandú cigüeña".split()
PLAIN = "la luz de mi casa por el camino con una flor y todo lo que tengo para ti en este mar".split()


def _song(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(SPANISH if r.random() < 0.4 else PLAIN) for _ in range(n))


def _songs(spark, change):
    data = [(k, change(k, _song(k)), "x") for k in range(300)]
    return spark.createDataFrame(data, "row_id long, lyrics string, text string")


def test_known_swaps_are_found_and_undone(spark):
    ways = {
        1: lambda s: s.encode("utf-8").decode("cp1252", "replace").replace("�", "") if "Ã\x81" in s else s.encode("utf-8").decode("latin-1"),
        2: lambda s: s.encode("cp1252").decode("mac_roman"),
        3: lambda s: s.encode("cp1252").decode("cp437"),
        4: lambda s: s.encode("utf-8").decode("mac_roman"),
        5: lambda s: s.encode("utf-8").decode("latin-1").encode("utf-8").decode("latin-1"),
        6: lambda s: s.replace("ó", "�"),
    }
    df = _songs(spark, lambda k, s: ways[k](s) if k in ways else s)
    got = {r.row_id: r for r in encodings.garbled(df, "row_id", ["lyrics"]).collect()}
    assert set(got) == set(ways)
    for k in (1, 2, 3, 4, 5):
        assert got[k].restored == _song(k) and got[k].complete, k
    assert not got[6].complete


def test_table_of_an_unknown_page_is_learned(spark):
    secret = str.maketrans("áéíóúñ", "⌬⍟◬◭⌖⍚")
    df = _songs(spark, lambda k, s: s.translate(secret) if k % 6 == 0 else s)
    learned = encodings.learn(df, "row_id", ["lyrics"])
    table = learned[0].tables[encodings.UNKNOWN]
    assert table and all(secret[ord(v)] == ord(k) for k, v in table.items())
    got = {r.row_id for r in encodings.garbled(df, "row_id", ["lyrics"], learned).collect()}
    assert got == {k for k in range(300) if k % 6 == 0}


def test_tables_of_suspected_pages_are_learned(spark):
    df = _songs(spark, lambda k, s: s.encode("cp1252").decode("cp437") if k % 15 == 0 else s)
    cipher, _ = encodings.learn(df, "row_id", ["lyrics"])
    table = cipher.tables["cp437", "cp1252"]
    assert table and all(x.encode("cp437").decode("cp1252") == c for x, c in table.items())
    assert {r.row_id for r in encodings.garbled(df, "row_id", ["lyrics"]).collect()} == {k for k in range(300) if k % 15 == 0}


@pytest.mark.parametrize(("shown", "true"), encodings.SOURCES)
def test_symbols_are_what_is_deciphered(shown, true):
    for word in ("corazÃ³n", "Ã¡rbol’", "РїСЂРёРІРµС‚", "‚±‚ñ‚É", "ŒŽ", "caf‚", "æ–‡å­—", "año", "àáâ"):
        parts, text = encodings.symbols(word, shown, true), encodings.decipher(word, shown, true)
        if parts is not None:
            assert "".join(c for _, c in parts) == (text or word) and "".join(x for x, _ in parts) == word


@pytest.mark.parametrize(("shown", "true"), [s for s in encodings.SOURCES if s[1] in ("cp932", "euc_jp")])
def test_an_end_that_is_cut_off_stands_for_itself(shown, true):
    r, page = random.Random(1), {b: c for c, b in encodings.PAGES[shown].items()}
    words = ["".join(page.get(r.choice([r.randint(128, 255), r.randint(33, 126)]), "x") for _ in range(r.randint(4, 7))) for _ in range(20000)]
    words += ["".join(page.get(b, "x") for b in "川の古い".encode(true) + b) for b in (b"\x85\xc2", b"\x8f\xa2\xb7a", b"\xa1,", b"\x85;")]
    cut = 0
    for word in words:
        parts = encodings.symbols(word, shown, true)
        if parts is not None:
            assert all(x for x, _ in parts) and "".join(x for x, _ in parts) == word and "".join(c for _, c in parts) == encodings.decipher(word, shown, true)
            assert all(encodings.symbols(x, shown, true) == [(x, c)] for x, c in parts if x != c)
            cut += parts[-1] == (word[-1], word[-1]) and word[-1] > "\x7f"
    assert cut


def test_words_with_an_end_that_is_cut_off_are_learned_from(spark):
    songs = ["川は古い家の下にある", "彼らは戻らなかった", "青い自転車を海の向こうへ投げた"]
    ways = {k: songs[k % 3].encode("euc_jp")[: 12 + k % 4].decode("latin-1") + end for k, end in zip(range(40, 80), ["¤)", "°L", "¤,", "É2"] * 10, strict=True)}
    df = _songs(spark, lambda k, s: ways.get(k, songs[k % 3] if k % 2 else s))
    cipher, _ = encodings.learn(df, "row_id", ["lyrics"])
    assert all(x for table in cipher.tables.values() for x in table)
    assert set(ways) <= {r.row_id for r in encodings.garbled(df, "row_id", ["lyrics"]).collect()}


def test_found_has_the_rows_of_the_restored(spark):
    df = _songs(spark, lambda k, s: s.encode("utf-8").decode("latin-1") if k in (3, 5) else s)
    df = df.unionByName(df.filter("row_id = 3")).unionByName(df.filter("row_id = 5").withColumn("row_id", F.lit(None).cast("long")))
    got = [tuple(r) for r in encodings.found(df, "row_id", ["lyrics"]).collect()]
    assert sorted(got, key=str) == sorted(((r.row_id, r.field_name) for r in encodings.garbled(df, "row_id", ["lyrics"]).collect()), key=str)
    assert sorted(str(a) for a, _ in got) == ["3", "3", "5", "None"]


def test_rare_but_correct_signs_are_no_case(spark):
    odd = {7: "L’Âme de João, Ærø 50 % — «no» ♫ 👩‍🎤 … naïve", 8: "JOÃO E OS ANÕES", 9: "", 10: None, 11: " ", 12: "a" * 300000 + "é"}
    df = _songs(spark, lambda k, s: odd.get(k, s))
    assert encodings.garbled(df, "row_id", ["lyrics", "text"]).count() == 0
    assert encodings.garbled(df.limit(0), "row_id", ["lyrics"]).count() == 0


# distinctive terms


def test_scores_equal_the_formula(spark):
    docs = [(1, "aaa bbb aaa", "ccc"), (2, "bbb ccc", None), (3, None, ""), (4, "aaa " * 5, "ddd"), (5, "aaa bbb aaa", "ccc"), (6, "ÁÉ12 x_y ab", "ñandú")]
    df = spark.createDataFrame(docs, "id int, a string, b string").withColumn("term", F.lit("q")).withColumn("y", F.lit(9))
    got = {(r.id, r.term): (r.y, r.df, r.c, round(r.z, 9)) for r in distinctive.score_terms(df, "id", ["a", "b"], prior=10.0).collect()}
    counts = {i: collections.Counter(f"{a or ''} {b or ''}".split()) for i, a, b in docs if i != 6}
    counts[6] = collections.Counter(["nandu"])
    big, c, df_ = sum(sum(x.values()) for x in counts.values()), collections.Counter(), collections.Counter()
    for x in counts.values():
        c.update(x), df_.update(x.keys())
    want = {}
    for i, x in counts.items():
        n = sum(x.values())
        for w, y in x.items():
            a = 10.0 * c[w] / big
            own, rest = math.log((y + a) / (n + 10 - y - a)), math.log((c[w] - y + a) / (big - n + 10 - (c[w] - y) - a))
            want[i, w] = (y, df_[w], c[w], round((own - rest) / math.sqrt(1 / (y + a) + 1 / (c[w] - y + a)), 9))
    assert got == want
    top = distinctive.top_terms(df, "id", ["a", "b"], k=1).collect()
    assert {r.id for r in top} == {1, 2, 4, 5, 6}
    bounded = distinctive.score_terms(df, "id", ["a", "b"], min_count=2, min_df=2, max_df=3, prior=10.0)
    assert {(r.id, r.term) for r in bounded.collect()} == {(1, "aaa"), (4, "aaa"), (5, "aaa")}
    assert distinctive.score_terms(df.limit(0), "id", ["a", "b"]).count() == 0


def test_found_terms_need_no_score(spark, tmp_path):
    from quillon.llm import queries

    songs = [(1, "t", "filler " * 20000 + "rare rare rare"), (2, "t", "rare " * 1000), (3, "t", "filler")]
    spark.createDataFrame(songs, "row_id long, track_name string, lyrics string").write.parquet(f"{tmp_path}/spotify_songs.parquet")
    assert {(1, "rare"), (2, "rare")} <= set(rows(queries.p2_found(spark, str(tmp_path))))


def test_found_terms_come_without_scores(spark, tmp_path, monkeypatch):
    from quillon.llm import queries

    songs = [(1, "t", "rare rare rare"), (2, "t", "rare twice twice twice"), (2, None, "twice common common common"), (3, "t", "common")]
    songs += [(k, "common", None) for k in range(4, 10)]
    spark.createDataFrame(songs, "row_id long, track_name string, lyrics string").write.parquet(f"{tmp_path}/spotify_songs.parquet")
    staged, stage = [], distinctive.stage
    monkeypatch.setattr(distinctive, "stage", lambda df, label="stage", *a: staged.append((label, df.columns)) or stage(df, label, *a))
    assert rows(queries.p2_found(spark, str(tmp_path))) == [(1, "rare")]
    assert staged == [("record_terms", ["_id", "term", "y"]), ("terms", ["term"])]


def test_terms_within_are_those_scored(spark):
    docs = [(k, " ".join(random.Random(k).choices(["aaa", "bbb", "ccc", "ddd", "eee", "fff"], k=8)), None) for k in range(30)] + [(30, None, ""), (31, "ab 12", None)]
    df = spark.createDataFrame(docs, "id int, a string, b string")
    for bounds in ({}, {"min_count": 2}, {"min_count": 3, "min_df": 2, "max_df": 22}):
        got = rows(distinctive.terms_within(df, "id", ["a", "b"], **bounds))
        assert got and got == rows(distinctive.score_terms(df, "id", ["a", "b"], **bounds).select("id", "term")), bounds
    assert distinctive.terms_within(df.limit(0), "id", ["a", "b"]).count() == 0


# languages

WORDS = {
    "en": "the river is under my old house and they never came back with you".split(),
    "es": "el río está bajo mi casa vieja y ellos nunca volvieron con la luna".split(),
    "de": "der fluss ist unter meinem alten haus und sie kamen nie zurück mit dir".split(),
    "ru": "река под моим старым домом и они никогда не вернулись ко мне".split(),
    "ja": "川は 古い家の 下に ある そして 彼らは 戻らなかった".split(),
}


def _lines(lang, n, seed):
    r = random.Random(seed)
    return [" ".join(r.choice(WORDS[lang]) for _ in range(8)) for _ in range(n)]


def test_languages_of_texts_and_stretches(spark):
    data = [(100 + 10 * k + j, "\n".join(_lines(x, 10, 100 * k + j)), x) for k, x in enumerate(WORDS) for j in range(10)]
    special = [
        (1, "\n".join(_lines("en", 6, 1) + [""] + _lines("es", 4, 2)), "en_GB"), (2, "\n".join(_lines("de", 9, 3)), " "), (3, "\n".join(_lines("ru", 9, 4)), "EN"),
        (4, "\n".join(_lines("es", 9, 5)), "es-MX"), (5, None, None), (6, "", "en"), (7, "12 34\n??", "und"), (8, "\n".join(_lines("en", 9, 6) + _lines("es", 1, 7)), "EN"),
        (9, "\n".join(_lines("ja", 8, 8)), None), (10, "\n".join(_lines("en", 7, 9)), None), (11, "\n".join(_lines("en", 3000, 10)), "de"),
    ]
    df = spark.createDataFrame(data + special, "row_id long, lyrics string, lyrics_lang string").withColumn("lang", F.lit("xx")).withColumn("text", F.lit(1))
    model = languages.fit(df, "row_id", "lyrics", "lyrics_lang")
    found = languages.languages(df, "row_id", "lyrics", "lyrics_lang", model)
    assert found.count() == df.count()
    got = rows(languages.doubtful(found, "row_id", 8))
    assert got == [(1, "en"), (1, "es"), (11, "en"), (2, "de"), (3, "ru"), (9, "ja")]
    parts = languages.stretches(df.filter("row_id in (1, 5, 6)"), "row_id", "lyrics", model).orderBy("first_line").collect()
    assert [(p.row_id, p.first_line, p.last_line, p.lang) for p in parts] == [(1, 0, 5, "en"), (1, 7, 10, "es")]
    assert all(0.5 < p.confidence <= 1 for p in parts)
    held_out = spark.createDataFrame([(k, "\n".join(_lines(x, 8, 999 + k)), x) for k, x in enumerate(list(WORDS) * 10)], "row_id long, lyrics string, lyrics_lang string")
    right = [list(r.langs) == [r.label] for r in languages.languages(held_out, "row_id", "lyrics", "lyrics_lang", model).collect()]
    assert sum(right) == len(right)
    empty = languages.fit(df.limit(0), "row_id", "lyrics", "lyrics_lang")
    assert languages.languages(df.limit(0), "row_id", "lyrics", "lyrics_lang", empty).count() == 0


# tokens


@pytest.fixture(scope="module")
def same_vocabulary():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


TEXTS = ["", None, "Hello  world\n\n it's 12,5 € <|endoftext|>", "日本語のテキスト", "👩‍🎤 ♫", " \t ", "x" * 5000, "don't  stop\r\n" * 9000, "नमस्ते दुनिया", "a b​c"]


def test_ids_equal_another_implementation_and_decode_back(spark, same_vocabulary):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(2, TEXTS[2])], "doc_id long, text string").withColumn("ids", F.lit("z")).withColumn("_id", F.lit(1))
    out = tokens.encode(df, "doc_id", "text", piece=1000)
    got = {r.doc_id: list(r.ids) for r in out.collect()}
    assert out.count() == len(TEXTS) + 1
    for k, t in enumerate(TEXTS):
        assert got[k] == (same_vocabulary.encode(t, add_special_tokens=False).ids if t else []), k
    back = {r.doc_id: r.text for r in tokens.decode(out, "doc_id", "ids").collect()}
    assert back == {k: t or "" for k, t in enumerate(TEXTS)}
    sizes = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df, "text").collect()}
    assert sizes == {k: len(v) for k, v in got.items()}
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab'st 1\n\t,é 日", max_size=60))
def test_safe_boundaries_change_no_id(text):
    enc = tokens.encoding()
    assert tokens.encode_text(enc, text, 3) == enc.encode_ordinary(text)
    assert "".join(tokens.pieces(text, 3)) == text


# mixing


def test_weights():
    sizes = {"a": 900.0, "b": 90.0, "c": 10.0, "d": 0.0}
    t, w = mixing.tempered(sizes, 0.9)
    assert abs(mixing.entropy(w) - 0.9) < 1e-6 and set(w) == {"a", "b", "c"} and 0 < t < 1
    t, total, w = mixing.limited(sizes, {"a": 1, "b": 1, "c": 2, "d": 5}, {"a": 2, "b": 2, "c": 3, "d": 9})
    assert (t, total, w["c"]) == (1.0, pytest.approx(60.0), pytest.approx(0.5))
    t, total, w = mixing.limited(sizes, {"a": 1, "c": 1}, {"a": 1, "c": 1}, total=500)
    assert 0 < t < 1 and w["c"] * total == pytest.approx(10, rel=1e-3) and sum(w.values()) == pytest.approx(1)
    assert mixing.limited({}, {"a": 1}, {"a": 1})[2] == {}


def test_mix_meets_shares_and_limits(spark):
    r = random.Random(5)
    data = [(k, " ".join(["word"] * r.randint(1, 40)), "Big-One " if k % 7 == 0 else "big_one") for k in range(2000)]
    data += [(5000 + k, " ".join(["word"] * r.randint(1, 40)), "small") for k in range(60)] + [(9000, None, "small"), (9001, "", "small"), (9002, "x", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("size", F.lit(-1)).withColumn("copies", F.lit(0))
    targets = spark.createDataFrame([("m", "big_one", 6.0, 3), ("m", "SMALL", 4.0, 4), ("m", "none", 1.0, 2), ("m", "zero", 0.0, 2), ("n", "small", 1.0, 2)], "mix_name string, source string, target_weight double, max_repeats int")
    mixed, report = mixing.mixed_documents(docs, targets, "doc_id", "text", "source")
    got = {(x.mix_name, x.source): x for x in report.collect()}
    assert abs(got["m", "big_one"].actual_share - 0.6) < 0.02 and got["m", "none"].docs == 0 == got["m", "zero"].tokens
    assert got["m", "small"].max_copies <= 4 and got["n", "small"].actual_share == 1.0 and got["n", "small"].docs == 60
    assert got["m", "none"].target_share == pytest.approx(1 / 11, abs=1e-5)
    taken = rows(mixed)
    assert taken == rows(mixing.mixed_documents(docs, targets, "doc_id", "text", "source")[0])  # the same on every run
    assert mixing.mixed_documents(docs.limit(0), targets, "doc_id", "text", "source")[0].count() == 0


def test_mix_of_all_tokens_bisects_the_exponent(spark, tmp_path):
    from quillon.llm import queries

    docs = [(k, "word " * 10, "big") for k in range(400)] + [(1000 + k, "word " * 10, "small") for k in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    targets = [("m", "big", 0.5, 2), ("m", "small", 0.5, 2), ("m", "none", 0.5, 2), ("n", "big", 0.9, 2), ("n", "small", 0.1, 2)]
    spark.createDataFrame(targets, "mix_name string, source string, target_weight double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    got = {(r.mix_name, r.source): r for r in queries.p9_held_shares(spark, str(tmp_path)).collect()}
    held = got["n", "big"].tokens + got["n", "small"].tokens
    assert got["n", "big"].exponent == 1.0 and got["n", "big"].actual_share == pytest.approx(0.9, abs=0.01)
    # small gives all it may, twice its tokens, and big fills the rest
    assert 0 < got["m", "big"].exponent < 1 and (got["m", "small"].docs, got["m", "small"].max_copies) == (40, 2)
    assert abs(got["m", "big"].tokens + got["m", "small"].tokens - held) < 0.01 * held
    free = {(r.mix_name, r.source): r for r in queries.p9_shares(spark, str(tmp_path)).collect()}
    assert free["m", "big"].exponent == 1.0 and free["m", "big"].actual_share == pytest.approx(0.5, abs=0.01)


def test_part_goes_on_past_a_document_that_does_not_fit(spark):
    sizes = [(k, "a", 10) for k in range(600)] + [(900, "a", 3000), (901, "a", 95), (902, "a", 7)]
    documents = spark.createDataFrame(sizes, "id long, source string, size long")
    names = [f"m{k}" for k in range(6)]
    targets = spark.createDataFrame([(m, "a", 1.0, 1) for m in names], "mix_name string, source string, target_weight double, max_repeats int")
    planned = mixing.plan(documents, targets, total=5000)
    taken = collections.defaultdict(list)
    for r in mixing.mix(documents, planned).collect():
        assert r.copies == 1
        taken[r.mix_name].append(r.size)
    # documents of 10 are left over everywhere, so less than 10 is missing
    assert {m: 4990 < sum(taken[m]) <= 5000 for m in names} == dict.fromkeys(names, True)


# sentences


def _split(text):
    out, last = [], 0
    for end in sentences.sentence_ends(text):
        out.append(text[last:end].strip(sentences.BLANKS + "\n\r"))
        last = end
    return out


CASES = [
    ("Dr. Smith left at 8 p.m. The U.K. pressing costs $3.50, e.g. vol. 2. Fine!", ["Dr. Smith left at 8 p.m.", "The U.K. pressing costs $3.50, e.g. vol. 2.", "Fine!"]),
    ("“Is it?” asked Mrs. Roe. “No.” She left.", ["“Is it?” asked Mrs. Roe.", "“No.”", "She left."]),
    ("She sang (really!) well. Open take_3.mp3 and wait... the hiss fades.", ["She sang (really!) well.", "Open take_3.mp3 and wait... the hiss fades."]),
    ("over the hill.Then down!Why?", ["over the hill.", "Then down!", "Why?"]),
    ("oh no!! you left me. i cried", ["oh no!!", "you left me.", "i cried"]),
    ("List:\n1. one thing\r\n2) two\n\n- three ...\n", ["List:", "1. one thing", "2) two", "- three ..."]),
    ("Am 3. März sang Hr. Meyer. Laut Nr. 4 d. h. Seite 11 fehlt er. „Lauter!“, rief er. Er sagte: „Gut.“ Dann ging er.",
     ["Am 3. März sang Hr. Meyer.", "Laut Nr. 4 d. h. Seite 11 fehlt er.", "„Lauter!“, rief er.", "Er sagte: „Gut.“", "Dann ging er."]),
    ("« Plus fort ! » cria M. Dupont. J.-P. Roux partit.", ["« Plus fort ! » cria M. Dupont.", "J.-P. Roux partit."]),
    ("«¡Más fuerte!», gritó. El n.º 2 vive en EE. UU. desde 2.010. ¿Vienes? ¡Sí!", ["«¡Más fuerte!», gritó.", "El n.º 2 vive en EE. UU. desde 2.010.", "¿Vienes?", "¡Sí!"]),
    ("«Громче!» — крикнул А. В. Петров. Стоит 1,4 руб. и т. д. Конец.", ["«Громче!» — крикнул А. В. Петров.", "Стоит 1,4 руб. и т. д.", "Конец."]),
    ("「もう一度！」と彼は言った。彼は「終わりだ。」とつぶやいた。3.5円です", ["「もう一度！」と彼は言った。", "彼は「終わりだ。」とつぶやいた。", "3.5円です"]),
    ("“再大声一点！”他喊道。他说：“好。”然后走了……真的。", ["“再大声一点！”他喊道。", "他说：“好。”", "然后走了……真的。"]),
    ("เขาไป เธออยู่ 3 วัน", ["เขาไป", "เธออยู่ 3 วัน"]),
    ("वह गया। “ज़ोर से!” राम ने कहा। श्री. X आए?", ["वह गया।", "“ज़ोर से!” राम ने कहा।", "श्री. X आए?"]),
    ("صاح علي: «ارفع الصوت!» ثم مضى. هل هذا هو؟ نعم.", ["صاح علي: «ارفع الصوت!» ثم مضى.", "هل هذا هو؟", "نعم."]),
    ("", []), ("  \n 　\n", []), ("no mark", ["no mark"]), ("Wait...\nGo", ["Wait...", "Go"]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_sentences(text, want):
    assert _split(text) == want


@pytest.mark.parametrize("n", [1, 47, 48, 500])
def test_runs_of_blanks_and_closing_signs_of_any_length(n):
    assert _split("She left." + " " * n + "He stayed.") == ["She left.", "He stayed."]
    assert _split("She left." + ")" * n + " He stayed.") == ["She left." + ")" * n, "He stayed."]


def test_sentence_rows_have_positions(spark):
    texts = [c[0] for c in CASES] + [None, CASES[0][0], "One. " * 40000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("_text", F.lit("z"))
    got = sentences.sentences(df, "doc_id", "text", with_text=True).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.doc_id, r.n)):
        assert texts[r.doc_id][r.start_pos : r.end_pos] == r.sentence
        by[r.doc_id].append(r.sentence)
    assert len(by[len(texts) - 1]) == 40000 and by[0] == CASES[0][1] == by[len(texts) - 2]
    assert sentences.sentences(df.limit(0), "doc_id", "text").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='aB. !?"“”«»()\n…。」「เ1', max_size=50))
def test_sentence_ends_are_in_order_and_cover_the_text(text):
    ends = sentences.sentence_ends(text)
    assert ends == sorted(set(ends))
    assert not text[ends[-1] if ends else 0 :].strip(sentences.BLANKS + "\n")


def test_tables_of_a_language_come_first():
    at = lambda text, lang: sentences.sentence_ends(text, lang)
    assert at("Ich weiß es. Dann ging ich.", "de") == [12, 27]  # an abbreviation in Italian
    assert at("Am 3. März sang Hr. Meier.", "de") == [26] and at("Am 3. März sang Hr. Meier.", "fr") == [26]  # labels can be wrong
    for lang in (None, "en", "xx"):
        for n in (1, 40, 60, 500):
            assert at("He went home." + " " * n + "Then he slept.", lang) == [13, 27 + n]
    assert [name for name, _ in sentences.cascade("de")].index("de") < [name for name, _ in sentences.cascade("de")].index("others")
