"""Sentence boundaries in prose of many languages and scripts (problem 8), in SQL expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Abbreviations, by what may follow them.
#: Before a capital, a digit or an opening mark: titles, references, units.
BEFORE_NAMES = (
    "Dr Mr Mrs Ms Prof St Mt Sr Sra Srta Dra Lic Ing Hr Fr Lt Laut Rev Gen Col Capt Cpt Sgt Hon Gov Sen Rep Messrs Mme Mlle Mgr M MM Me Cía EE "
    "Univ Dept Abt Geb Inst Bd Co vs approx ca bzw evtl ggf usf inkl exkl Abb Tab Kap Bsp Anm Aufl Bd Hrsg vgl Vgl u Str Tel "
    "éd env fig Fig Figs Eq Eqs Sec chap Chap Cf cf aprox pág págs núm Núm núms "
    "Проф проф ул д кв г гг стр рис табл см См ок акад им пр просп пл гл Гл ред изд т тел "
    "डॉ क्र रु पृ प्रो सं د ص أ م ا ج ดร นาย นาง ศ รศ ผศ"
).split()
#: Before a digit only.
BEFORE_NUMBERS = "s S art Art ch Ch cap Cap tel No no Nos nos Nr nr Vol vol Vols pp p P ext Ext op Op v V Bl Blatt тыс млн млрд руб".split()
MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split()
ORDINAL_AFTER = "der die das dem den des am im vom zum beim ab seit bis".split()

DOT, MARK, END = "\ue000", "\ue001", "\ue0ff"
STOP = r"[.!?…؟۔]"
CLOSE = r"(?:[”’»)\]〉》」』]|[\"'“‘](?![\p{L}\p{N}]))"
HOST = r"\p{Ll}[\w-]+[.@][\w]"
START = rf"(?:[\p{{Lu}}\p{{Lo}}\p{{Lt}}\p{{N}}«“\"„(\[¿¡‘'「『（《$€£#§*]|{HOST})"

#: (pattern, replacement) in order. Each keeps every character's place, and starts at the stop itself: what stands before it is looked at
#: only there. MASKS hide stops that end nothing, ENDS mark the ends.
MASKS: list[tuple[str, str]] = [
    # decimals, versions, dates, addresses, host and file names: a stop between two word characters, unless a capitalised word begins there
    (r"\.(?<=[\p{L}\p{N}_/-]\.)(?=[\p{Ll}\p{N}_])", DOT),
    (r"\.(?<=\p{N}\.)(?=\p{Lu}(?![\p{Ll}\s’']))", DOT),
    (r"\.(?<=(?<!\p{L})\p{L}\.)(?=\p{L}(?!\p{L}))", DOT),
    # a question mark inside an address
    (r"\?(?<=[\w/]\?)(?=[\w&%]+=)", MARK),
    # abbreviations before names and numbers
    (r"\.(?<=(?<![\p{L}\p{M}])(?:" + "|".join(BEFORE_NAMES) + r")\.)(?=\s*[\p{L}\p{N}«“\"„(])", DOT),
    (r"\.(?<=(?<![\p{L}\p{M}])(?:" + "|".join(BEFORE_NUMBERS) + r")\.)(?=\s*\p{N})", DOT),
    (r"\.(?<=(?<!\p{L})[Zz]\.)(?=\s*B\.)", DOT),
    (r"\.(?<=(?<!\p{L})[Zz]" + DOT + r"\s{0,2}B\.)", DOT),
    # initials, unless a number stands before the letter (a unit)
    (r"\.(?<=(?<![\p{L}\p{M}\p{N}])(?<!\p{N}\s)(?<!\p{N}\r\n)\p{Lu}\.)(?=[\s-]*\p{Lu})", DOT),
    # ordinals
    (r"\.(?<=(?<!\p{L})(?:" + "|".join(ORDINAL_AFTER) + "|" + "|".join(w.capitalize() for w in ORDINAL_AFTER) + r")\s{1,2}\p{N}{1,2}\.)(?=\s+\p{Lu})", DOT),
    (r"\.(?<=\p{N}\.)(?=\s+(?:" + "|".join(MONTHS) + r")(?!\p{L}))", DOT),
    # list numbers: at the start, after a blank line, or after a sentence end
    (rf"\.(?<=(?:^|\n\s{{0,4}}\n\s{{0,4}}|{STOP}[”’»)\]\"“]?\s{{1,3}}|[。！？।]\s{{0,3}})\(?\p{{N}}{{1,3}}\.)(?=\s+\S)", DOT),
    # a quoted question inside a longer sentence, in scripts without capitals
    (r"[?!](?<=[ऀ-ॿ][?!])(?=[\"”’»](?!\s*\n\s*\n)\s+\S)", MARK),
    (r"[?؟!](?=[»”\"](?!\s*\n\s*\n)\s+[؀-ۿ])", MARK),
    (r"[？?](?=[”’]\p{Lo})", MARK),
    (r"[。！？!?](?=[」』”’）》]+(?:[，、；：,;]|と|って))", MARK),
]
ENDS: list[tuple[str, str]] = [
    (r"(\s*\n\s*\n)", END + "$1"),
    (rf"([。！？।॥]+{CLOSE}*[）]?{CLOSE}*)", "$1" + END),
    (rf"({STOP}+{CLOSE}*(?:[\u0020\u00a0\u202f]»)?)(?=\s+{START})", "$1" + END),
    # a missing space does not join two sentences
    (rf"((?:\.(?<=(?:[\p{{Ll}}\p{{M}}]{{2}}|\p{{N}}|\p{{N}}\s\p{{Lu}}|[ap][.{DOT}]m|[)”’»\"])\.)|[!?…]){CLOSE}*)(?=[“„«¿¡]?\p{{Lu}}(?:[\p{{Ll}}\s’']|))", "$1" + END),
    (r"([.؟!](?<=[؀-ۿ]{2}[.؟!]))(?=[ء-ي])", "$1" + END),
    (r"(\s+)(?<=[ก-๛]\s{1,3})(?=[ก-๛])", END + "$1"),
]


def _replace(text: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, rule: F.regexp_replace(c, F.lit(rule[0]), F.lit(rule[1])), rules, text)


def marked(text: Column) -> Column:
    """``text`` with masked stops and a private-use END after every sentence; without the ENDs it has the length of ``text``."""
    return _replace(_replace(F.translate(text, END, ""), MASKS), ENDS)


def sentences(documents: DataFrame) -> DataFrame:
    """``doc_id, sentence, start_pos, end_pos``: the sentences of each document's prose, numbered from 0, with code-point offsets in ``text``.

    ``documents`` has ``doc_id, text, body_from, body_to``; the prose is the range [body_from, body_to). Rows with a null in any of the
    four have no sentences, nor has an empty or blank range; bounds beyond the text are cut to it. Repeated rows give repeated sentences
    only once. Every text is processed whole; the only shuffle carries piece lengths, grouped by document.
    """
    body = F.expr("substring(text, cast(body_from as int) + 1, greatest(cast(body_to - body_from as int), 0))")
    rows = documents.where("doc_id is not null and text is not null and body_from is not null and body_to is not null").select("doc_id", F.col("body_from").cast("long").alias("_from"), body.alias("_b"))
    pieces = rows.select("doc_id", "_from", F.posexplode(F.split(marked(F.col("_b")), END)).alias("_k", "_t"))
    blank = "[\\s\u00a0\u202f\u200b\u200c\u200d\u2060\ufeff]+"
    left = F.length("_t") - F.length(F.regexp_replace("_t", "^" + blank, ""))
    seen = F.length(F.regexp_replace("_t", blank + "$", ""))
    sizes = pieces.select("doc_id", "_from", "_k", F.length("_t").alias("_n"), left.alias("_l"), seen.alias("_s")).distinct()
    before = Window.partitionBy("doc_id", "_from").orderBy("_k")
    placed = sizes.withColumn("_at", F.col("_from") + F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("_s > 0")
    return placed.select("doc_id", (F.row_number().over(before) - 1).alias("sentence"), (F.col("_at") + F.col("_l")).alias("start_pos"), (F.col("_at") + F.col("_s")).alias("end_pos"))


def sentence_texts(documents: DataFrame) -> DataFrame:
    """``doc_id, sentence, start_pos, end_pos, text``: ``sentences`` with the text of each.

    What was masked is restored by place: masking keeps every character's place, so a sentence is cut out of the untouched prose. Numbers,
    places and texts are all found within a document's row; only repeated rows meet in a shuffle.
    """
    body = F.expr("substring(text, cast(body_from as int) + 1, greatest(cast(body_to - body_from as int), 0))")
    rows = documents.where("doc_id is not null and text is not null and body_from is not null and body_to is not null").select("doc_id", F.col("body_from").cast("long").alias("_from"), F.translate(body, END, "").alias("_b"))
    rows = rows.withColumn("_p", F.split(marked(F.col("_b")), END))
    ends = F.aggregate(F.transform("_p", F.length), F.array(F.lit(0)), lambda at, n: F.array_append(at, F.element_at(at, -1) + n))
    blank = "[\\s\u00a0\u202f\u200b\u200c\u200d\u2060\ufeff]+"

    def place(piece: Column, at: Column) -> Column:
        lead = F.length(piece) - F.length(F.regexp_replace(piece, "^" + blank, ""))
        return F.struct((at + lead).alias("a"), (at + F.length(F.regexp_replace(piece, blank + "$", ""))).alias("z"))

    # both arrays are arguments of the function, not names inside it: they are found once a row
    rows = rows.withColumn("_at", ends).withColumn("_s", F.filter(F.zip_with("_p", "_at", place), lambda x: x["z"] > x["a"]))
    # outer: a plain explode would let the optimizer repeat all expressions in a filter for rows without sentences
    out = rows.select("doc_id", "_from", "_b", F.posexplode_outer("_s").alias("sentence", "_x")).where("_x is not null")
    text = F.expr("substring(_b, _x.a + 1, _x.z - _x.a)")
    return out.select("doc_id", "sentence", (F.col("_from") + F.col("_x.a")).alias("start_pos"), (F.col("_from") + F.col("_x.z")).alias("end_pos"), text.alias("text")).distinct()


def found(documents: DataFrame) -> DataFrame:
    return sentences(documents).select("doc_id", "end_pos")
