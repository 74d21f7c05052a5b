"""Keyword-stuffed pages, link lists and product tags among encyclopedia texts.

Texts are cut into segments: sentences of a long line together up to some 300 characters,
short lines together likewise. Four features of a segment, each drawn towards what is
usual by how little the segment holds:

* ``sparse``: the share of words that are no function words (a link counts as words, a
  number as neither; in Japanese, characters that are not hiragana);
* ``repeated``: how often the words that are no function words come in the whole text
  (mean of their binary logarithms);
* ``uniform``: the entropy that these words lack within the segment, as the share of words said before;
* ``dense``: the density of links, tags and prices.

Location, scale and scatter of the features are estimated robustly for each language
over the segments of all documents. A segment is an outlier if its robust Mahalanobis
distance, taken over the components that point the way of spam, is beyond the
chi-square limit, and spam if it lacks function words besides. A page is spam if more than half the
characters of its text are in such segments: nothing but the distance tells which.

All of this works on columns: regular expressions, dictionaries and sums over a batch's
texts, no text on its own. Headings, categories, redirects and names of templates and parameters are no words.

Defined cases: a NULL, empty or blank text is no spam; repeated rows come out
repeatedly; a NULL identifier stays; texts of any length are read whole; a segment
without function words has the language of its document, a document without any its
label's, an unknown label the numbers of all languages; an empty table gives an empty
result. Only identifier, text and language label are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.session import materialize

# Function words (articles, prepositions, pronouns, conjunctions, auxiliaries, particles) by language.
FUNCTION_WORDS = {
    "en": "the a an of to in on at by for with from into onto upon about between among against through during before after above below over under "
          "behind near beside until since without within along across around toward towards despite except as than and or but nor so yet if because "
          "although though while whereas unless whether that this these those which who whom whose what when where why how i you he she it we they me "
          "him her us them my your his its our their mine yours theirs myself itself themselves himself herself is am are was were be been being have "
          "has had having do does did will would shall should can could may might must not no there here all any each every some none both either "
          "neither one such own same",
    "fr": "le la les l un une des du de d au aux ce cet cette ces mon ma mes ton ta tes son sa ses notre nos votre vos leur leurs à dans sur sous en par "
          "pour avec sans vers chez entre contre depuis pendant avant après devant derrière jusque jusqu près malgré selon hors et ou ni mais donc or "
          "car que qu qui quoi dont où si comme quand lorsque puisque tandis je tu il elle on nous vous ils elles me te se s y lui eux moi toi ne n pas "
          "plus point rien jamais est sont était étaient fut furent être été a ai as ont avait avaient eut ait avoir",
    "de": "der die das den dem des ein eine einen einem einer eines kein keine keinen in im an am auf aus bei beim mit nach von vom zu zum zur für durch "
          "gegen ohne um über unter vor hinter neben zwischen seit bis während wegen trotz laut und oder aber denn sondern dass daß ob weil obwohl wenn "
          "als wie damit nachdem bevor ich du er sie es wir ihr man mich dich sich uns euch ihn ihm ihnen mein dein sein seine seinen seinem seiner ihre "
          "ihren ihrem ihrer unser dieser diese dieses diesen diesem jener welche wer was wo nicht ist sind war waren sei bin wird wurde wurden werden "
          "worden hat haben hatte hatten kann können muss soll davon dazu daran darin hier dort",
    "es": "el la los las lo un una unos unas de del a al en con por para sin sobre entre hasta desde hacia según contra ante bajo tras durante y e o u ni "
          "pero sino aunque porque pues que quien quienes cual cuales cuyo cuya donde cuando como si yo tú él ella ello nosotros ellos ellas me te se nos "
          "os le les mi tu su sus este esta estos estas ese esa esos esas aquel aquella no es son era eran fue fueron ser sido está están estaba ha han "
          "había haber",
    "ru": "в во на с со из от до по за к ко у о об обо при про для без под над перед между через около после и а но или да что чтобы как если когда потому "
          "хотя пока ли же бы не ни я ты он она оно мы вы они меня его её ему ей их им нас вас себя свой свою этот эта это эти этого тот та то те "
          "того той который которая которое которые которого которой кто кем чем где здесь там тут был была было были есть быть будет",
    "ar": "في من إلى على عن مع بعد قبل بين عند حتى منذ خلال تحت فوق نحو دون سوى كل بعض غير و أو ثم لكن بل أن إن لأن كي إذا لو كما حيث هو هي هم هن أنا نحن "
          "أنت هذا هذه ذلك تلك التي الذي الذين ما لا لم لن ليس قد كان كانت يكون أي وهو وهي وفي ومن وعلى ولا ولم ومع",
}
LANGUAGES = (*FUNCTION_WORDS, "ja")
FEATURES = ("sparse", "repeated", "uniform", "dense")
CHI2_LIMIT = 18.47  # 0.999 quantile for four features
LEAST_LACK = 1.5  # scales by which a spam segment's function words are fewer than usual
LEAST_SHARE = 0.5
SEGMENT_CHARS = 300
LONG_LINE = 200  # characters from which a line is cut alone; shorter ones are joined
USUAL_WORDS = 4  # words of the usual kind that every segment is taken to have besides its own
LINK_WORDS = 3  # words that an address counts as
TAG_CHARS = 8  # characters that a tag or price counts as
LEAST_WORDS = 8  # of a segment that location and scatter are estimated from
COMMON_WEIGHT = 200  # segments that those of all languages count as, beside a language's own
SLICE_BYTES = 4_000_000  # of text worked on at a time
_BINS = (1000, 100, 1000, 1000)  # bins for each unit of a feature
_FLOOR = np.array([0.07, 0.5, 0.1, 0.1])  # least scales, so that very uniform texts have a scatter
_CLIP = 3.0

_VOCABULARY: dict[str, int] = {}
for _i, _words in enumerate(FUNCTION_WORDS.values()):
    for _w in _words.split():
        _VOCABULARY[_w] = _VOCABULARY.get(_w, 0) | 1 << _i
_WORD_SET = pa.array(list(_VOCABULARY))
_WORD_LANGUAGES = np.array(list(_VOCABULARY.values()))

_INVISIBLE = "[​-‏⁠﻿­]"
_NO_WORDS = (r"(?m)^#[^\s\[]+:?\s*\[\[[^\]\n]*\]\]", r"\[\[[^\]|:\n]{2,20}:[^\]\n]*\]\]", r"(?m)^=+[^=\n]+=+\s*$")  # redirects, categories, headings
_SENTENCE_END = r"([.!?؟]) |(。)"
_ADDRESS = r"https?://[^\s<>\[\]|\"{}]+"
_WIKILINK = r"\[\[[^\[\]]*\]\]"
_MARKUP = r"<[^<>]{0,300}>|\{\{+[^{}|\n]{0,60}|\|[^=|\n]{1,20}=|\{\{\{[^{}|\n]{0,40}|\[\[[^\]|:\n]{2,20}:"  # tags, names of templates and parameters
_BETWEEN_WORDS = r"[^\p{L}\p{M}\p{N}@+$_]+"
_NUMBER = r"[0-9][0-9.,]*"
_TAG = r"[€$£¥]|\bsku\b|(?:^|\s)#[^\s\d]"
_CJK, _HIRAGANA = "[぀-ヿ㐀-鿿]", "[ぁ-ゟ]"


def normal_label(label: str | None) -> str:
    """A language label without case and suffix; ``other`` if it is none of those known."""
    short = (label or "").strip().lower()[:2]
    return short if short in LANGUAGES else "other"


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(which list each item is of, items)."""
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten()


def _ints(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False).astype(np.int64)


def _pieces(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(text, piece, characters, segment) of the sentences and lines of texts; segments are numbered in order."""
    line_text, lines = _flat(pc.split_pattern(texts, "\n"))
    line, pieces = _flat(pc.split_pattern(pc.replace_substring_regex(lines, _SENTENCE_END, "\\1\\2\n"), "\n"))
    chars = _ints(pc.utf8_length(pieces))
    there = chars > 0
    line, chars, pieces = line[there], chars[there], pieces.filter(pa.array(there))
    text = line_text[line]
    if not len(line):
        return text, pieces, chars, line
    long = np.bincount(line, weights=chars, minlength=len(lines))[line] >= LONG_LINE
    new = np.ones(len(line), dtype=bool)  # whether a piece begins a long line or a run of short ones
    new[1:] = ~((line[1:] == line[:-1]) | ~long[1:] & ~long[:-1] & (text[1:] == text[:-1]))
    run = np.cumsum(new) - 1
    before = np.cumsum(chars) - chars
    window = (before - before[new][run]) // SEGMENT_CHARS
    new[1:] |= window[1:] != window[:-1]
    return text, pieces, chars, np.cumsum(new) - 1


#: What is kept of a segment: the number of its language, its characters, words (addresses included), function words,
#: numbers, words that are no function words, the sum of the logarithms of their counts, how many of them are distinct, characters of links and tags.
FACTS = ("of", "chars", "words", "function", "numbers", "plain", "recurrence", "distinct", "linked")


def segment_facts(texts: pa.Array, labels: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """(text of each segment, its FACTS, the number of each text's language); the last number is ``other``."""
    low = pc.utf8_lower(pc.replace_substring_regex(texts.fill_null(""), _INVISIBLE, ""))
    for pattern in _NO_WORDS:
        low = pc.replace_substring_regex(low, pattern, " ")
    text, pieces, chars, seg = _pieces(low)
    size = int(seg[-1]) + 1 if len(seg) else 0
    add = lambda w, at=seg: np.bincount(at, weights=w, minlength=size)
    seg_text = np.zeros(size, dtype=np.int64)
    seg_text[seg] = text
    rest = pc.replace_substring_regex(pieces, _ADDRESS, "")
    left = _ints(pc.utf8_length(pc.replace_substring_regex(rest, _WIKILINK, "")))
    addresses = _ints(pc.count_substring_regex(pieces, "https?://"))
    clean = pc.replace_substring_regex(rest, _MARKUP, "  ")
    piece, words = _flat(pc.split_pattern_regex(clean, _BETWEEN_WORDS))
    spoken = pc.match_substring_regex(words, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
    piece, words = piece[spoken], words.filter(pa.array(spoken))
    at, of_text = seg[piece], text[piece]
    enc = words.dictionary_encode()
    code, most = enc.indices.to_numpy(), max(1, len(enc.dictionary))
    known = pc.index_in(enc.dictionary, value_set=_WORD_SET)
    is_function = known.is_valid().to_numpy(zero_copy_only=False).astype(bool)
    spoken_in = np.where(is_function, _WORD_LANGUAGES[known.fill_null(0).to_numpy(zero_copy_only=False)], 0)[code]
    function = is_function[code]
    plain = ~function
    _, cell, count = np.unique(of_text[plain] * most + code[plain], return_inverse=True, return_counts=True)
    distinct = np.unique(at[plain] * most + code[plain]) // most
    cjk, hiragana = (add(_ints(pc.count_substring_regex(pieces, p))) for p in (_CJK, _HIRAGANA))
    all_chars = add(chars)
    japanese = cjk >= 0.3 * np.maximum(all_chars, 1)
    votes = np.stack([*[add((spoken_in >> i) & 1, at) for i in range(len(FUNCTION_WORDS))], cjk / 3], axis=1)
    of_texts = np.stack([np.bincount(seg_text, weights=v, minlength=len(texts)) for v in votes.T], axis=1)
    other = len(LANGUAGES)
    place = {x: i for i, x in enumerate(LANGUAGES)}
    labelled = np.array([place.get(normal_label(x), other) for x in labels.to_pylist()], dtype=np.int64)
    text_language = np.where(of_texts.max(axis=1, initial=0) > 0, of_texts.argmax(axis=1), labelled) if len(texts) else labelled
    language = seg_text
    if size:
        own = text_language[seg_text]
        weighed = votes * (1 + (np.arange(other) == own[:, None]))  # a word of the text's own language counts twice
        language = np.where(votes.max(axis=1) > 0, weighed.argmax(axis=1), own)
    facts = {
        "of": language, "chars": all_chars, "words": np.where(japanese, cjk, np.bincount(at, minlength=size)) + LINK_WORDS * add(addresses),
        "function": np.where(japanese, hiragana, add(function, at)), "numbers": add(_ints(pc.count_substring_regex(clean, _NUMBER))),
        "plain": np.bincount(at[plain], minlength=size), "recurrence": add(np.log2(count[cell]), at[plain]), "distinct": np.bincount(distinct, minlength=size),
        "linked": add(chars - left + TAG_CHARS * _ints(pc.count_substring_regex(pieces, _TAG))),
    }
    return seg_text, facts, text_language


def _slices(b: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch cut where SLICE_BYTES of text are together; a longer text is a slice of its own."""
    size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
    for x, y in zip(cuts, cuts[1:]):
        if x < y:
            yield b.slice(x, y - x)


def _measurer(id_col: str, text_col: str, lang_col: str):
    """mapInArrow body: documents -> their language and lists of their segments' facts."""
    names = pa.array([*LANGUAGES, "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, text_col):
                seg_text, facts, language = segment_facts(b.column(text_col), b.column(lang_col))
                offsets = pa.array(np.append(0, np.cumsum(np.bincount(seg_text, minlength=b.num_rows))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(facts[f].astype(np.float32))) for f in FACTS]
                yield pa.RecordBatch.from_arrays([b.column(id_col), names.take(pa.array(language)), *lists], [id_col, "language", *FACTS])

    return run


def page_segments(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, language, a list for each of FACTS) of every document; no exchange."""
    kind = documents.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, language string, " + ", ".join(f"{f} array<float>" for f in FACTS)
    return documents.select(id_col, text_col, lang_col).mapInArrow(_measurer(id_col, text_col, lang_col), schema)


@dataclass(frozen=True)
class Scatter:
    """Of a language: location and scale of the features, inverse of the scatter of clipped standard values."""

    location: np.ndarray
    scale: np.ndarray
    inverse: np.ndarray


def _facts_of(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {f: b.column(f).flatten().to_numpy(zero_copy_only=False).astype(np.float64) for f in FACTS}


def _raw(x: dict[str, np.ndarray]) -> np.ndarray:
    """The features of segments as they are, a row each."""
    plain = np.maximum(x["plain"], 1)
    return np.stack([1 - x["function"] / np.maximum(x["words"], 1), x["recurrence"] / plain, 1 - x["distinct"] / plain - (x["plain"] == 0),
                     np.minimum(1, x["linked"] / np.maximum(x["chars"], 1))], axis=1)


def _standard(x: dict[str, np.ndarray], places: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Standard values of the features, drawn towards 0 by how little a segment holds."""
    raw = _raw(x)
    usual = USUAL_WORDS * np.ones(len(raw))
    weight = np.stack([x["words"] / (x["words"] + usual + x["numbers"]), *[x["plain"] / (x["plain"] + usual)] * 2, np.ones(len(raw))], axis=1)
    location, scale = (np.array([places[i][k] for i in range(len(LANGUAGES) + 1)]) for k in (0, 1))
    of = x["of"].astype(np.int64)
    return weight * (raw - location[of]) / scale[of]


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: (language, feature, bin, segments)."""
    for b in batches:
        x = _facts_of(b)
        enough = x["words"] >= LEAST_WORDS
        raw, of = _raw(x)[enough], x["of"][enough].astype(np.int64)
        for k, per in enumerate(_BINS):
            cell, n = np.unique((of << 32) + np.rint(raw[:, k] * per).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell >> 32), pa.array(np.full(len(cell), k)), pa.array(cell & 0xFFFFFFFF), pa.array(n.astype(np.int64))], ["g", "k", "bin", "n"])


def _middle(values: np.ndarray, weights: np.ndarray) -> float:
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weights[order])
    return float(values[order][np.searchsorted(upto, upto[-1] / 2)])


def _places(segments: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """number of a language -> (medians, scales): exact to a bin, from counts of bins; ``other`` has those of all languages.

    What has no language tells nothing of how texts usually are, and is left out. Languages and bins are closed sets, which bounds what comes to the driver.
    """
    counted = (segments.mapInArrow(_histograms, "g bigint, k bigint, bin bigint, n bigint").filter(F.col("g") < len(LANGUAGES))
               .groupBy("g", "k", "bin").agg(F.sum("n")).collect())
    if not counted:
        return {}
    g, k, at, n = (np.array(c, dtype=np.float64) for c in zip(*counted))
    out = {}
    for i in range(len(LANGUAGES) + 1):
        location, scale = np.zeros(len(FEATURES)), np.zeros(len(FEATURES))
        for j, per in enumerate(_BINS):
            mine = k == j
            weight = n[mine] * ((g[mine] == i) + COMMON_WEIGHT / n[mine].sum())
            value = at[mine] / per
            location[j] = _middle(value, weight)
            away = value <= location[j]  # the side that spam is not on, so spam does not widen the scale
            scale[j] = max(1.4826 * _middle(location[j] - value[away], weight[away]), _FLOOR[j])
        out[i] = location, scale
    return out


def _products(places: dict[int, tuple[np.ndarray, np.ndarray]]):
    """mapInArrow body: (language, segments, sums of products of clipped standard values), of segments that are no outliers by scales alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _facts_of(b)
            enough = x["words"] >= LEAST_WORDS
            z = _standard(x, places)
            enough &= x["of"] < len(LANGUAGES)
            enough &= (np.maximum(z, 0) ** 2).sum(axis=1) <= CHI2_LIMIT  # outliers do not widen the scatter
            z, of = np.clip(z[enough], -_CLIP, _CLIP), x["of"][enough].astype(np.int64)
            for i in np.unique(of).tolist():
                mine = z[of == i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i]), pa.array([len(mine)]), *[pa.array([v]) for v in (mine.T @ mine).ravel()]], ["g", "n", *_CELLS])

    return run


_CELLS = [f"c{i}_{j}" for i in range(len(FEATURES)) for j in range(len(FEATURES))]


def robust_scatter(segments: DataFrame) -> dict[int, Scatter]:
    """number of a language -> its Scatter, over the segments of all documents that hold enough words.

    Each language's numbers are drawn towards those of all, the more the fewer segments it has.
    """
    places = _places(segments)
    if not places:
        return {}
    schema = "g bigint, n bigint, " + ", ".join(f"{c} double" for c in _CELLS)
    sums = segments.mapInArrow(_products(places), schema).groupBy("g").agg(F.sum("n"), *[F.sum(c) for c in _CELLS]).collect()
    k = len(FEATURES)
    if not sums:
        return {}
    n = {r[0]: r[1] for r in sums}
    total = {r[0]: np.array(r[2:], dtype=np.float64).reshape(k, k) for r in sums}
    common = sum(total.values()) / sum(n.values())
    out = {}
    for i, (location, scale) in places.items():
        scatter = (total.get(i, 0) + COMMON_WEIGHT * common) / (n.get(i, 0) + COMMON_WEIGHT)
        out[i] = Scatter(location, scale, np.linalg.inv(scatter + 0.05 * np.eye(k)))
    return out


def _judge(id_col: str, scatter: dict[int, Scatter], limit: float, least_lack: float):
    """mapInArrow body: documents -> the share of their characters in spam segments, and the mean distance of those."""
    places = {i: (s.location, s.scale) for i, s in scatter.items()}
    inverse = np.array([scatter[i].inverse for i in range(len(LANGUAGES) + 1)]) if scatter else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _facts_of(b)
            doc = np.repeat(np.arange(b.num_rows), b.column("chars").value_lengths().to_numpy(zero_copy_only=False))
            z = _standard(x, places)
            way = np.maximum(z, 0)
            distance = np.einsum("ij,ijk,ik->i", way, inverse[x["of"].astype(np.int64)], way)
            spam = x["chars"] * ((distance > limit) & (z[:, 0] > least_lack))
            add = lambda w: np.bincount(doc, weights=w, minlength=b.num_rows)
            bare = add(spam)
            share = bare / np.maximum(add(x["chars"]), 1)
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col), b.column("language"), pa.array(share), pa.array(add(spam * distance) / np.maximum(bare, 1))], [id_col, "language", "share", "distance"])

    return run


def judged_pages(segments: DataFrame, scatter: dict[int, Scatter], id_col: str = "doc_id", limit: float = CHI2_LIMIT, least_lack: float = LEAST_LACK) -> DataFrame:
    """(id, language, share of characters in spam segments, their mean squared distance) of every document."""
    kind = segments.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, language string, share double, distance double"
    if not scatter:  # no segment holds enough words to estimate anything from
        return segments.select(id_col, "language", F.lit(0.0).alias("share"), F.lit(0.0).alias("distance"))
    return segments.mapInArrow(_judge(id_col, scatter, limit, least_lack), schema)


def spam_pages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
               limit: float = CHI2_LIMIT, least_share: float = LEAST_SHARE) -> DataFrame:
    """(id, language, share, distance) of the spam pages."""
    segments = materialize(page_segments(documents, id_col, text_col, lang_col), "page-segments")
    return judged_pages(segments, robust_scatter(segments), id_col, limit).filter(F.col("share") > least_share)
