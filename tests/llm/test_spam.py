import random

import numpy as np
import pytest

from tidemill.llm import spam

# Sentences of our own, of no text that the operator was tried on.
PROSE = {
    "en": ["The violin was tuned by a patient teacher who had once played for the king.", "Nobody could say whether the comet would return before the end of the century.",
           "She wrote to her brother that the winter had been mild and the roads were open.", "It is said that the first bakers of the town worked at night, because the ovens were shared.",
           "When the siege ended, they counted what was left and sent for more grain.", "A printer in the capital made the second edition, but it has not been found.",
           "He was the only one of the pilots to cross the strait without a compass.", "Many of the letters which he had promised to burn were kept in a tin box under the stairs."],
    "fr": ["Le violon avait été accordé par un maître patient qui jouait autrefois pour le roi.", "Personne ne savait si la comète serait de retour avant la fin du siècle.",
           "Elle écrivit à son frère que l'hiver était doux et que les routes étaient ouvertes.", "Les boulangers de la ville travaillaient la nuit, car ils n'avaient qu'un four pour tous.",
           "Quand le siège fut levé, on compta ce qui restait dans les greniers.", "Un imprimeur de la capitale en fit une autre édition, mais elle est perdue."],
    "de": ["Die Geige wurde von einem geduldigen Lehrer gestimmt, der einst für den König spielte.", "Niemand konnte sagen, ob der Komet vor dem Ende des Jahrhunderts wiederkehrt.",
           "Sie schrieb ihrem Bruder, dass der Winter mild war und die Straßen offen sind.", "Die Bäcker der Stadt arbeiteten in der Nacht, weil sie sich einen Ofen teilten.",
           "Als die Belagerung zu Ende war, zählten sie, was noch da war.", "Ein Drucker aus der Hauptstadt machte die zweite Auflage, aber sie ist nicht zu finden."],
    "es": ["El violín fue afinado por un maestro que había tocado para el rey.", "Nadie sabía si el cometa iba a volver antes del fin de siglo.",
           "Ella escribió a su hermano que el invierno era suave y que los caminos estaban abiertos.", "Los panaderos de la villa trabajaban de noche, porque no había más que un horno para todos.",
           "Cuando se acabó el asedio, contaron lo que les quedaba en los graneros.", "Un impresor de la capital hizo la segunda edición, pero no se ha encontrado."],
    "ru": ["Скрипку настроил терпеливый учитель, который когда-то играл для короля.", "Никто не знал, вернётся ли комета до конца века.",
           "Она писала брату, что зима была мягкой и что дороги были открыты.", "Пекари этого города работали по ночам, потому что печь у них была одна на всех.",
           "Когда осада была снята, они сосчитали то, что у них было в амбарах.", "Печатник из столицы сделал второе издание, но его не нашли."],
    "ar": ["كان المعلم الذي عزف للملك من قبل قد ضبط الكمان في المساء.", "لم يعرف أحد إن كان المذنب سوف يعود قبل نهاية القرن.",
           "كتبت إلى أخيها أن الشتاء كان لطيفا وأن الطرق من وإلى المدينة مفتوحة.", "كان خبازو هذه المدينة في الليل يعملون لأن الفرن كان لهم كل يوم.",
           "بعد أن انتهى الحصار لم يكن في المخازن سوى ما بقي من القمح.", "صنع طابع من العاصمة هذه الطبعة لكن لم يجدها أحد من بعد."],
    "ja": ["そのバイオリンは、かつて王のために弾いたことのある先生によって調えられた。", "彗星が世紀の終わりまでに戻ってくるかどうかは、だれにもわからなかった。",
           "彼女は兄に、冬はおだやかで道はまだ開いていると書いた。", "町のパン屋たちは、かまどが一つしかなかったので夜に働いていたという。",
           "包囲が終わると、彼らは残っているものを数えた。", "都の印刷屋が二つ目の版を作ったが、それはまだ見つかっていない。"],
}
GOODS = {"en": "sofa mattress perfume sneakers jacket sunglasses wallet vitamin laptop bracelet".split(), "fr": "canapé matelas parfum baskets veste lunettes vitamine bracelet".split(),
         "de": "Sofa Matratze Parfüm Turnschuhe Jacke Sonnenbrille Vitamine Armband".split(), "es": "colchón perfume zapatillas chaqueta gafas cartera vitaminas pulsera".split(),
         "ru": "диван матрас духи кроссовки куртка очки кошелёк браслет".split(), "ar": "أريكة مرتبة عطر حذاء سترة نظارات محفظة سوار".split(),
         "ja": ["格安寝具", "高級香水", "運動靴通販", "激安時計", "人気財布", "特価眼鏡"]}
PUSH = {"en": ["wholesale", "clearance", "voucher", "store", "official"], "fr": ["promotion", "solde", "magasin", "officiel"], "de": ["Rabatt", "Gutschein", "Laden", "Schnäppchen"],
        "es": ["rebajas", "oferta", "tienda", "oficial"], "ru": ["скидки", "распродажа", "магазин", "акция"], "ar": ["تخفيضات", "عروض", "متجر", "رسمي"], "ja": ["送料無料", "即日発送", "公式店"]}
CITIES = "Lagos Denver Osaka Turin Quebec Minsk Hanoi Porto Leeds Tampa".split()


def prose(rng, lang, n):
    return " ".join(rng.choice(PROSE[lang]) for _ in range(n)) if n < 4 else "\n\n".join(" ".join(rng.sample(PROSE[lang], 3)) for _ in range(n // 3))


def stuffed(rng, lang, kind, n):
    some = rng.sample(GOODS[lang], 4)
    word = lambda: rng.choice(some)
    push = lambda: rng.choice(PUSH[lang])
    shop = lambda: f"https://{rng.choice('abcdef')}{rng.randint(1, 99)}-store.example/{rng.choice(CITIES).lower()}/{rng.randint(1, 9999)}"
    if kind == "bag":
        return " ".join(rng.choice([word, push])() for _ in range(n * 10))
    if kind == "phrases":
        return ", ".join(rng.choice([f"{push()} {x}" for x in some]) for _ in range(n * 4))
    if kind == "places":
        return " ".join(f"{some[0]} {push()} {rng.choice(CITIES)}." for _ in range(n * 4))
    if kind == "lines":
        return "\n".join(f"{word()} {push()}" for _ in range(n * 5))
    if kind == "links":
        return "\n".join(f"* [{shop()} {word()} {push()}]" for _ in range(n * 2))
    if kind == "addresses":
        return " ".join(shop() for _ in range(n * 2))
    if kind == "tags":
        return " ".join(f"#{word()}{push()}{rng.choice(CITIES)}" for _ in range(n * 4))
    if kind == "hidden":
        return '<div style="display:none">' + " ".join(rng.choice([word, push])() for _ in range(n * 10)) + "</div>"
    if kind == "parameters":
        return "{{Infobox shop\n" + "\n".join(f"| tag{i} = " + ", ".join(f"{push()} {word()}" for _ in range(6)) for i in range(n)) + "\n}}"
    return "\n".join(f"* {word()} {push()} – SKU {rng.randint(1000, 99999)} – {rng.randint(5, 99)}.90 €" for _ in range(n * 3))


KINDS = ("bag", "phrases", "places", "lines", "links", "addresses", "tags", "hidden", "parameters", "products")
OTHER = ("prose", "short", "glossary", "references", "table", "infobox", "redirect", "song", "blank")


def fine(rng, lang, kind):
    say = lambda: rng.choice(PROSE[lang])
    if kind == "short":
        return f"'''{rng.choice(CITIES)}''' {say()}\n\n{{{{stub}}}}\n[[Category:{rng.choice(CITIES)}]]"
    if kind == "glossary":
        return "\n".join(f"; {rng.choice(CITIES)}\n: {say()}" for _ in range(9))
    if kind == "references":
        return "\n".join(f"# [https://library{i}.example/{i} {rng.choice(CITIES)}]. {say()}" for i in range(9))
    if kind == "table":
        rows = "\n".join(f"|-\n| {rng.choice(CITIES)} || {rng.randint(1900, 2020)} || {rng.randint(1, 99999)} || {rng.random() * 100:.2f}" for _ in range(20))
        return f'{say()} {say()}\n\n{{| class="wikitable"\n|+ {say()}\n! n !! %\n{rows}\n|}}'
    if kind == "infobox":
        return f"{{{{Infobox river\n| name = {rng.choice(CITIES)}\n| length = {rng.randint(9, 999)}\n| basin = {rng.randint(9, 9999)}\n| map = {rng.choice(CITIES)}.png\n}}}}\n\n{say()} {say()}"
    if kind == "redirect":
        return f"#REDIRECT [[{rng.choice(CITIES)}#History]]"
    if kind == "song":
        two = [say(), say()]
        return "<poem>\n" + "\n".join((two + [say()])[i % 3] for i in range(12)) + "\n</poem>"
    if kind == "blank":
        return rng.choice(["", "   ", "\n\n", " ", "0"])
    return prose(rng, lang, rng.choice([2, 6, 12]))


def corpus(seed=7):
    """(documents, ids of the spam among them): pages of every kind and language."""
    rng = random.Random(seed)
    rows, bad = [], set()
    for lang in PROSE:
        for kind in OTHER:
            for _ in range({"prose": 100, "short": 24}.get(kind, 8)):
                rows.append((len(rows), fine(rng, lang, kind), rng.choice([lang, lang.upper(), None])))
        for kind in KINDS:
            for share in (0, 1, 2):
                n = rng.choice([6, 12, 24])
                text = "\n\n".join([prose(rng, lang, share)] * bool(share) + [stuffed(rng, lang, kind, n)])
                bad.add(len(rows))
                rows.append((len(rows), text, rng.choice([lang, None])))
            # a little of it in a long article is no spam page
            rows.append((len(rows), prose(rng, lang, 24) + "\n\n" + stuffed(rng, lang, kind, 1), lang))
    return rows, bad


SCHEMA = "doc_id bigint, text string, lang string"


@pytest.fixture(scope="module")
def pages(spark):
    rows, bad = corpus()
    return spark.createDataFrame(rows, SCHEMA).repartition(4), rows, bad


def quality(found, bad):
    return len(found & bad) / max(1, len(found)), len(found & bad) / len(bad)


def test_pages_of_other_sentences(pages):
    df, _, bad = pages
    precision, recall = quality({r.doc_id for r in spam.spam_pages(df).collect()}, bad)
    assert precision > 0.9 and recall > 0.9, (precision, recall)


def test_every_kind_and_language_is_found(pages):
    df, rows, bad = pages
    found = {r.doc_id for r in spam.spam_pages(df).collect()}
    missed = [rows[i][1][:60] for i in sorted(bad - found)]
    assert len(missed) <= len(bad) // 20, missed


def test_the_distance_decides(pages):
    df, _, bad = pages
    near = {r.doc_id for r in spam.spam_pages(df).collect()}
    without = {r.doc_id for r in spam.spam_pages(df, limit=-1.0).collect()}
    assert near < without and quality(near, bad)[0] > quality(without, bad)[0]
    assert not {r.doc_id for r in spam.spam_pages(df, limit=1e9).collect()}


def test_half_the_characters(pages, spark):
    rng = random.Random(3)
    text = stuffed(rng, "en", "bag", 20)
    more = "\n\n".join([*[" ".join(PROSE["en"][:4])] * (2 * len(text) // len(" ".join(PROSE["en"][:4])))])
    df = pages[0].unionByName(spark.createDataFrame([(10_000, more + "\n\n" + text, "en"), (10_001, PROSE["en"][0] + "\n\n" + text, "en")], SCHEMA))
    share = {r.doc_id: r.share for r in spam.judged_pages(spam.page_segments(df), spam.robust_scatter(spam.page_segments(df))).filter("doc_id >= 10000").collect()}
    assert 0.2 < share[10_000] < 0.45 and share[10_001] > 0.8


def test_defined_cases(pages, spark):
    df, rows, _ = pages
    rng = random.Random(5)
    bag = stuffed(rng, "de", "bag", 12)
    odd = [(None, bag, None), (10_000, bag, "und"), (10_000, bag, "und"), (10_001, None, None), (10_002, "", "en"), (10_003, " \t\r\n ", "xx"), (10_004, "x" * 5_000, "en"),
           (10_005, "<|endoftext|>", None), (10_006, "hi", "en")]
    extra = df.unionByName(spark.createDataFrame(odd, SCHEMA)).selectExpr("*", "1.0 AS chars", "'z' AS language", "2 AS share")
    got = [r.doc_id for r in spam.spam_pages(extra).collect()]
    assert got.count(10_000) == 2 and got.count(None) == 1 and not {10_001, 10_002, 10_003, 10_005, 10_006} & set(got)
    assert spam.spam_pages(df.limit(0)).count() == 0
    assert spam.spam_pages(df.filter("text = ''")).count() == 0


def test_a_long_text_is_read_whole(pages, spark):
    rng = random.Random(9)
    head = "\n\n".join(" ".join(rng.sample(PROSE["en"], 3)) for _ in range(200))
    tail = "\n".join(stuffed(rng, "en", "lines", 40) for _ in range(20))
    df = pages[0].unionByName(spark.createDataFrame([(10_000, head + "\n\n" + tail[: len(head) // 2], "en"), (10_001, head + "\n\n" + (tail * 9)[: 2 * len(head)], "en")], SCHEMA))
    assert {r.doc_id for r in spam.spam_pages(df).filter("doc_id >= 10000").collect()} == {10_001}


def test_slices_do_not_matter(pages, monkeypatch):
    import pyarrow as pa

    rows = pages[1]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["doc_id", "text", "lang"])
    run = lambda: pa.Table.from_batches(spam._measurer("doc_id", "text", "lang")(iter([batch]))).combine_chunks()
    whole = run()
    monkeypatch.setattr(spam, "SLICE_BYTES", 5_000)
    assert run().to_pylist() == whole.to_pylist() and whole.num_rows == len(rows)


def test_segment_facts():
    import pyarrow as pa

    text, x, language = spam.segment_facts(pa.array(["== The head ==\nthe sofa and the sofa", None, "12 sofas https://a.example/b", "#REDIRECT [[The House]]"]), pa.array(["EN", None, "fr-x", ""]))
    assert [spam.LANGUAGES[i] if i < len(spam.LANGUAGES) else "other" for i in language] == ["en", "other", "fr", "other"]
    first = {k: v[text == 0].sum() for k, v in x.items()}
    assert (first["words"], first["function"], first["plain"], first["distinct"], first["recurrence"]) == (5, 3, 2, 1, 2.0)
    third = {k: v[text == 2].sum() for k, v in x.items()}
    assert (third["words"], third["numbers"], third["plain"]) == (1 + spam.LINK_WORDS, 1, 1) and third["linked"] == len("https://a.example/b")
    assert not x["words"][text == 3].sum() and 1 not in text


def test_labels():
    assert [spam.normal_label(x) for x in ("EN", "en-x", "und", None, "", "fr ")] == ["en", "en", "other", "other", "other", "fr"]


def test_scatter_does_not_jump_with_the_number_of_documents(spark):
    def location(n):
        rng = random.Random(1)
        texts = [(i, prose(rng, "en", 3), "en") for i in range(n)] + [(-i, stuffed(rng, "ru", "bag", 6), "ru") for i in range(1, 101)]
        return spam.robust_scatter(spam.page_segments(spark.createDataFrame(texts, SCHEMA)))[0].location

    assert np.abs(location(199) - location(201)).max() < 0.1


def test_long_texts_take_linear_time():
    import pyarrow as pa

    for t in ("." + " " * 200_000 + "x", "1" * 200_000, "[" * 100_000, "{{" * 50_000, "<" * 100_000, "a" * 200_000, ") ." * 60_000, "w " * 150_000, "\n" * 200_000):
        spam.segment_facts(pa.array([t]), pa.array([None], pa.string()))
