"""Personal data: candidate spans, boosted trees over format and context, calibrated thresholds. DataFrame functions only.

Four base kinds (email, ip, card, phone) are found by pattern and checked. Generators with high recall propose further spans,
which may overlap: runs of digits, tokens that look like keys, addresses written with "at". Boosted trees score them by format
and context. Their labels come from elsewhere: a candidate of a text is personal if a check says so (it overlaps a base span, with
its checksum or ranges, or has a well-known key format), and each sampled text gets one sentence planted whose span is known to be
personal or not. Other candidates of the texts have no label and aren't used. Of the rows kept apart for it, each generator gets a
monotone calibration, and its threshold is the lowest score from which on the wanted share is personal. What passes and overlaps
no base span is added by its generator's kind. Base spans always stay.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import fresh, table

BASE = ("email", "ip", "card", "phone")
#: Kinds of added spans, by generator.
ADDED = ("number", "key", "address")
KINDS = (*BASE, *ADDED)
# The contract's patterns, written so that each run of characters is entered once and never given back.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
DIGITS = r"(?<![A-Za-z0-9+(])\+?\(?[0-9](?:[\x20().,:/-]{0,2}+[0-9]){6,}+"
KEYLIKE = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{14,}+"
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]++(?:\x20?[(\[.](?:dot|DOT)?[)\]]?\x20?[A-Za-z0-9-]++)++"
KNOWN_KEY = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})$"
#: Context words before a candidate, by class, in English, French, German and Spanish; up to two short words may follow.
CONTEXT = {
    1: r"(?:token|pass ?wor[dt]|passwd|pwd|secr[eè]t|key|auth|mot de passe|jeton|cl[eé]|kennwort|schl[uü]ssel|geheim|contrase[nñ]a|clave)",
    2: r"(?:phone|t[eé]l|fax|mobile|call|whatsapp|portable|appele|handy|anruf|ruf|m[oó]vil|llam)",
    3: r"(?:card|visa|iban|account|ssn|passport|compte|carte|konto|(?:kredit)?karte|ausweis|cuenta|tarjeta)",
    4: r"(?:ip|host|server|addr|serveur|servidor)",
    5: r"(?:versi[oó]n|isbn|issn|section|chapter|page|doi|year|total|sum|commit|file|fichier|chapitre|ann[eé]e|seite|kapitel|abschnitt|jahr|datei|p[aá]gina|cap[ií]tulo|secci[oó]n|a[nñ]o|archivo|suma)",
}
AFTER = r"\p{L}{0,4}[^\p{L}]*(?:\p{L}{1,5}[^\p{L}]+){0,2}$"
SAMPLE_ROWS = 20_000
PRECISION = 0.95
ROUNDS = 24
RATE = 0.3
#: Features and how many values each has; the sample's counts have at most their product of rows.
FEATURES = {"generator": 3, "digits": 5, "letters": 4, "marks": 4, "context": 6, "lead": 4, "mixed": 2, "dot": 2}

SPAN = "array<struct<start: int, end: int, s: string>>"


def _literal(rx: str) -> str:
    return "r'" + rx.replace("'", "\\x27") + "'"


def spans(text: str, rx: str, where: Column) -> Column:
    """All leftmost non-overlapping matches of rx with code-point offsets; only rows that pass `where` are scanned."""
    r = _literal(rx)
    got = F.expr(
        f"aggregate(zip_with(slice(split({text}, {r}, -1), 1, size(regexp_extract_all({text}, {r}, 0))), regexp_extract_all({text}, {r}, 0),"
        " (gap, m) -> struct(char_length(gap) as skip, char_length(m) as len, m as s)),"
        f" struct(0 as at, cast(array() as {SPAN}) as found),"
        " (a, x) -> struct(a.at + x.skip + x.len as at, concat(a.found, array(struct(a.at + x.skip as start, a.at + x.skip + x.len as end, x.s as s))) as found),"
        " a -> a.found)"
    )
    return F.when(where, got).otherwise(F.expr(f"cast(array() as {SPAN})"))


def base_spans(docs: DataFrame, text: str) -> DataFrame:
    """docs with columns email, ip, card, phone: the checked matches of each kind."""
    digits = F.col(text).rlike("[0-9]")
    out = docs.withColumns({
        "email": spans(text, EMAIL, F.contains(F.col(text), F.lit("@"))),
        "ip": spans(text, IP, digits & F.col(text).rlike(r"[0-9]\.[0-9]")),
        "card": spans(text, CARD, digits),
        "phone": spans(text, PHONE, digits & F.contains(F.col(text), F.lit("+"))),
    })
    plain = r"regexp_replace(x.s, '[^0-9]', '')"
    return out.withColumns({
        "ip": F.expr("filter(ip, x -> forall(split(x.s, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(right(p, 3) as int), 0) <= 255))"),
        "card": F.expr(f"filter(card, x -> length({plain}) between 12 and 19 and luhn_check({plain}))"),
        "phone": F.expr(f"filter(phone, x -> length({plain}) between 9 and 15)"),
    })


def candidates(docs: DataFrame, text: str) -> DataFrame:
    """docs of base_spans with column proposed: the generators' spans with their features."""
    digits = F.col(text).rlike("[0-9]")
    out = docs.withColumn("base", F.concat("email", "ip", "card", "phone"))
    made = {"p0": spans(text, DIGITS, digits), "p1": spans(text, KEYLIKE, digits), "p2": spans(text, SPELLED, F.col(text).rlike(r"(?i)[(\[]at[)\]]"))}
    out = out.withColumns(made)
    raw = F.expr("concat(" + ", ".join(f"transform(p{i}, x -> struct({i} as generator, x.start as start, x.end as end, x.s as s))" for i in range(3)) + ")")
    context = " ".join(f"when rlike(c.before, r'(?iu)(?<!\\p{{L}}){rx}{AFTER}') then {n}" for n, rx in CONTEXT.items())
    features = f"""transform(raw, x -> transform(array(struct(x as x, substring({text}, greatest(x.start - 23, 1), least(x.start, 24)) as before,
        length(regexp_replace(x.s, '[^0-9]', '')) as d, length(regexp_replace(x.s, '[^A-Za-z]', '')) as l, length(regexp_replace(x.s, '[A-Za-z0-9]', '')) as m)), c -> struct(
        c.x.start as start, c.x.end as end, c.x.s as s, c.x.generator as generator,
        case when c.d = 0 then 0 when c.d < 9 then 1 when c.d < 12 then 2 when c.d < 16 then 3 else 4 end as digits,
        case when c.l = 0 then 0 when c.l < 5 then 1 when c.l < 17 then 2 else 3 end as letters,
        least(c.m, 3) as marks,
        case {context} else 0 end as context,
        case when startswith(c.x.s, '+') then 1 when startswith(c.x.s, '(') then 2 when rlike(c.x.s, '^[A-Z]') then 3 else 0 end as lead,
        cast(rlike(c.x.s, '[A-Za-z][0-9].*[A-Za-z][0-9]') as int) as mixed,
        cast(rlike(c.x.s, r'(?i)[(\\[]dot[)\\]]') as int) as dot))[0])"""
    return out.withColumn("raw", raw).withColumn("proposed", F.expr(features)).drop("p0", "p1", "p2", "raw")


OVERLAPS = "exists(base, b -> b.start < x.end and x.start < b.end)"


def boost(rows: list[tuple[tuple[int, ...], int, float]], rounds: int = ROUNDS, rate: float = RATE) -> list[tuple]:
    """Trees of two levels over discrete features, from (features, label, weight) rows, by gradient steps on the log loss.

    A tree is (feature, cut, (feature, cut, value, value), (feature, cut, value, value)): at most cut goes to the first part.
    """
    f, y, w = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
    score = np.zeros(len(rows))
    cuts = [(j, c) for j, n in enumerate(FEATURES.values()) for c in range(n - 1)]
    low = np.array([f[:, j] <= c for j, c in cuts])
    trees: list[tuple] = []

    def split(g: np.ndarray, h: np.ndarray) -> tuple[int, float, float]:
        """The best cut of rows with these gradients, and the values of its parts."""
        ga, ha = low @ g, low @ h
        gb, hb = g.sum() - ga, h.sum() - ha
        gain = ga * ga / (ha + 1) + gb * gb / (hb + 1)
        i = int(np.argmax(gain >= gain.max() - 1e-9))
        return i, float(ga[i] / (ha[i] + 1)), float(gb[i] / (hb[i] + 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = w * (y - p), w * p * (1 - p)
        i = split(g, h)[0]
        parts = [(k, rate * a, rate * b) for k, a, b in (split(g * side, h * side) for side in (low[i], ~low[i]))]
        trees.append((*cuts[i], *((*cuts[k], a, b) for k, a, b in parts)))
        for side, (k, a, b) in zip((low[i], ~low[i]), parts):
            score += side * np.where(low[k], a, b)
    return trees


def _apply(tree: tuple, f: tuple[int, ...]) -> float:
    j, c, low, high = tree
    k, d, a, b = low if f[j] <= c else high
    return a if f[k] <= d else b


def threshold(rows: list[tuple[tuple[int, ...], int, float]], trees: list[tuple], precision: float = PRECISION) -> float:
    """The lowest score from which on the rows kept apart, calibrated, have the precision; infinite if no score has.

    The calibration is the monotone step function of the score that fits the labels best: neighbours that fall are pooled.
    """
    by: dict[float, list[float]] = {}
    for f, y, w in rows:
        s = by.setdefault(sum(_apply(t, f) for t in trees), [0.0, 0.0])
        s[0] += w * y
        s[1] += w
    pools: list[list[float]] = []  # lowest score, weight of label 1, weight
    for s in sorted(by):
        pools.append([s, *by[s]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, good, all_ = pools.pop()
            pools[-1] = [pools[-1][0], pools[-1][1] + good, pools[-1][2] + all_]
    best, good, all_ = math.inf, 0.0, 0.0
    for s, g, n in reversed(pools):
        good, all_ = good + g, all_ + n
        if good >= precision * all_ and 2 * g >= n:
            best = s
    return best


#: What a sentence to plant has for a span, by name: SQL over {h}, 64 hex digits of the text, {d}, its decimal digits, and {k}, 0 to 7.
FORMS = {
    "hex": "substring({h}, 1, 14 + 3 * {k})", "mixed": "concat(upper(substring({h}, 1, 8)), 'q', substring({h}, 9, 8 + {k}))", "known": "concat('AKIA', upper(translate(substring({h}, 1, 16), '0123', 'GHIJ')))",
    "long": "concat('Zq', substring({h}, 1, 20 + {k}), translate(substring({h}, 1, 12), '0123456789', 'GHIJKLMNOP'))",
    "spaced": "concat('0', substring({d}, 1, 3), ' ', substring({d}, 4, 3), ' ', substring({d}, 7, 4))", "bracketed": "concat('(', substring({d}, 1, 3), ') ', substring({d}, 4, 3), '-', substring({d}, 7, 4))",
    "run": "substring({d}, 1, 9 + {k} % 8)", "dashed": "concat(substring({d}, 1, 3), '-', substring({d}, 4, 2), '-', substring({d}, 6, 4))", "pairs": "concat('0', substring({d}, 1, 1), ' ', substring({d}, 2, 2), ' ', substring({d}, 4, 2), ' ', substring({d}, 6, 2), ' ', substring({d}, 8, 2))",
    "spelled": "concat('me', substring({h}, 1, 4), ' (at) host', substring({h}, 5, 3), ' (dot) org')", "squared": "concat('x.', substring({h}, 1, 5), ' [at] ', 'site', substring({h}, 5, 2), ' [dot] net')",
    "names": "concat(translate(substring({h}, 1, 4), '0123456789', 'ghijklmnop'), '.', translate(substring({h}, 5, 3 + {k}), '0123456789', 'ghijklmnop'), ' (at) ', translate(substring({h}, 16, 6), '0123456789', 'ghijklmnop'), ' (dot) com')",
    "remark": "concat(translate(substring({h}, 1, 5), '0123456789', 'ghijklmnop'), ' (at) ', translate(substring({h}, 9, 5), '0123456789', 'ghijklmnop'), '.', 'And')", "aside": "concat('look (at) this.', 'then')",
    "sha": "substring({h}, 1, 40)", "dotted": "concat(substring({d}, 1, 2), '.', substring({d}, 3, 2), '.', substring({d}, 5, 4), '.', substring({d}, 9, 3 + {k} % 3))",
    "isbn": "concat('978-', substring({d}, 1, 1), '-', substring({d}, 2, 2), '-', substring({d}, 4, 6), '-', substring({d}, 10, 1))", "date": "concat('20', substring({d}, 1, 2), '-1', substring({d}, 3, 1), '-', substring({d}, 4, 2), ' 1', substring({d}, 6, 1), ':', substring({d}, 7, 2))",
    "slug": "concat('the-long-way-', substring({d}, 1, 4))", "grouped": "concat(substring({d}, 1, 2), ',', substring({d}, 3, 3), ',', substring({d}, 6, 3))", "parts": "concat(substring({d}, 1, 3), '.', substring({d}, 4, 3), '.', substring({d}, 7, 3))",
    "serial": "substring({d}, 1, 13 + {k} % 6)", "file": "concat('img_', substring({d}, 1, 8), '-final-copy')", "plain": "substring({d}, 1, 8 + {k} % 6)",
}
#: What stands before a span in each language, by language; the spans it may have, and whether they are personal.
LEADS = [
    (("password=", "mot de passe : ", "passwort: ", "contraseña: "), ("hex", "mixed", "long"), 1), (('token = "', "jeton ", "schlüssel ", "clave "), ("hex", "long", "mixed"), 1), (("use ", "avec ", "mit ", "con "), ("known",), 1),
    (("auth key ", "clé secrète ", "geheim: ", "clave secreta "), ("long", "hex"), 1), (("call me on ", "appelez le ", "anruf unter ", "llama al "), ("spaced", "bracketed", "pairs", "run"), 1),
    (("tel: ", "tél. ", "tel. ", "tel. "), ("bracketed", "spaced", "pairs", "run"), 1), (("mobile ", "portable ", "handy ", "móvil "), ("run", "pairs", "spaced", "bracketed"), 1), (("account no. ", "compte ", "konto ", "cuenta "), ("run", "dashed"), 1),
    (("ssn ", "passport ", "ausweis ", "iban "), ("dashed", "run"), 1), (("write to ", "écrire à ", "mail an ", "escribe a "), ("spelled", "squared", "names"), 1), (("ask ", "voir ", "frag ", "pide a "), ("names", "spelled", "squared"), 1),
    (("reach me: ", "voici ", "hier ", "aquí "), ("run",), 1), (("we ", "nous ", "wir ", "ellos "), ("remark", "aside"), 0), (("commit ", "commit ", "commit ", "commit "), ("sha", "hex"), 0), (("the version ", "la version ", "version ", "la versión "), ("dotted", "parts"), 0),
    (("isbn ", "isbn ", "isbn ", "isbn "), ("isbn",), 0), (("on ", "le ", "am ", "el "), ("date",), 0), (("see page ", "voir page ", "siehe seite ", "ver página "), ("slug", "plain"), 0),
    (("a total of ", "un total de ", "summe: ", "suma de "), ("grouped", "plain", "parts"), 0), (("in section ", "chapitre ", "abschnitt ", "sección "), ("parts", "dotted"), 0), (("file ", "fichier ", "datei ", "archivo "), ("file", "slug"), 0),
    (("the sum ", "année ", "jahr ", "año "), ("plain",), 0), (("order ", "commande ", "bestellung ", "pedido "), ("serial", "plain"), 0), (("and the ", "pour la ", "und die ", "en la "), ("serial",), 0),
    (("that ", "dans ", "nicht ", "como "), ("serial", "plain"), 0),
]
#: All sentences to plant: what stands before the span, the span's name in FORMS, and whether it is personal.
PLANTED = [(lead, form, personal) for leads, forms, personal in LEADS for lead in dict.fromkeys(leads) for form in forms]


def planted(docs: DataFrame, text: str, sentences: list[tuple[str, str, int]] = PLANTED) -> DataFrame:
    """docs with one of the sentences added to the text: at and until are its span's code points, personal says what it is, and
    turn which of the sentences it is, from 1."""
    docs = docs.withColumn("h", F.sha2(text, 256)).withColumn("d", F.translate("h", "abcdef", "718293"))
    said = {name: F.expr(sql.format(h="h", d="d", k="(ascii(h) % 8)")) for name, sql in FORMS.items()}
    docs = docs.withColumn("turn", F.expr(f"cast(pmod(xxhash64(h), {len(sentences)}) + 1 as int)"))
    of = lambda i: F.element_at(F.array(*(F.lit(x[i]) for x in sentences)), F.col("turn"))
    docs = docs.withColumns({"lead": of(0), "form": of(1), "personal": of(2)})
    words = F.when(F.lit(False), F.lit(""))
    for name, c in said.items():
        words = words.when(F.col("form") == name, c)
    docs = docs.withColumn("said", words)
    docs = docs.withColumn("at", F.char_length(text) + 1 + F.char_length("lead")).withColumn("until", F.col("at") + F.char_length("said"))
    return docs.withColumn(text, F.concat(F.col(text), F.lit(" "), F.col("lead"), F.col("said"), F.lit('" and so on'))).drop("h", "d", "lead", "form", "said")


Model = tuple[list[tuple], list[float]]


def labelled(docs: DataFrame, text: str) -> DataFrame:
    """The features of the candidates with a label (personal) in planted docs, with column apart of the document."""
    inside = "(x.start < until and at < x.end)"
    label = f"case when {inside} then personal when {OVERLAPS} or rlike(x.s, r'{KNOWN_KEY}') then 1 end"
    seen = candidates(base_spans(docs, text), text).select("apart", F.explode(F.expr(f"filter(transform(proposed, x -> struct(x as x, {label} as y)), c -> c.y is not null)")).alias("c"))
    return seen.select("apart", *(F.col(f"c.x.{n}").alias(n) for n in FEATURES), F.col("c.y").alias("y"))


def fitted(docs: DataFrame, text: str, rows: int = SAMPLE_ROWS, sentences: list[tuple[str, str, int]] = PLANTED) -> Model:
    """Trees, and a threshold for each generator, from about `rows` rows with a sentence planted in each; without both classes no
    threshold is in reach."""
    total, none = docs.count(), ([], [math.inf] * len(ADDED))
    if not total:
        return none
    hashed = F.pmod(F.xxhash64(F.lit("pii"), F.col(text)), F.lit(1 << 20))
    few = docs.where(hashed < int(min(1.0, rows / total) * (1 << 20)) + 1).select(text, (hashed % 3 == 0).alias("apart"))
    counts = labelled(planted(few, text, sentences), text).groupBy("apart", *FEATURES, "y").agg(F.count("*").alias("n")).collect()
    parts: dict[bool, list] = {True: [], False: []}
    for r in counts:
        parts[r["apart"]].append((tuple(r[n] for n in FEATURES), int(r["y"]), float(r["n"])))
    parts = {k: sorted(v) for k, v in parts.items()}
    if len({y for _, y, _ in parts[False]}) < 2:
        return none
    trees, generator = boost(parts[False]), list(FEATURES).index("generator")
    return trees, [threshold([r for r in parts[True] if r[0][generator] == g], trees) for g in range(len(ADDED))]


def _score(trees: list[tuple]) -> str:
    names = list(FEATURES)

    def low(t: tuple) -> str:
        return f"if(x.{names[t[0]]} <= {t[1]}, {t[2]!r}D, {t[3]!r}D)"

    return " + ".join(f"if(x.{names[j]} <= {c}, {low(a)}, {low(b)})" for j, c, a, b in trees) or "0D"


def find(docs: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """docs with column spans: array of (kind, start, end) by start and kind, code points, end exclusive.

    Null and empty texts have no spans, and very long ones are searched as any. Each row is searched on its whole text alone, so
    repeated rows agree; an empty table stays empty. A column named spans is replaced; no other name clashes.
    """
    own = docs.drop("spans")
    rows = own.select(F.struct(*(F.col(f"`{c}`") for c in own.columns)).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"))
    trees, least = model if model is not None else fitted(rows.select("body"), "body")
    if all(map(math.isinf, least)):
        rows = base_spans(rows, "body").withColumns({c: F.expr(f"cast(array() as {SPAN})") for c in ADDED})
    else:
        passes = " ".join(f"when {g} then {'false' if math.isinf(x) else f'{_score(trees)} >= {x!r}D'}" for g, x in enumerate(least))
        rows = candidates(base_spans(rows, "body"), "body").withColumn("added", F.expr(f"filter(proposed, x -> not {OVERLAPS} and case x.generator {passes} end)"))
        rows = rows.withColumns({c: F.expr(f"filter(added, x -> x.generator = {g})") for g, c in enumerate(ADDED)})
    every = ", ".join(f"transform({c}, x -> struct(x.start as start, {i} as ord, x.end as end))" for i, c in enumerate(KINDS))
    names = ", ".join(f"'{k}'" for k in KINDS)
    named = F.expr(f"transform(array_distinct(array_sort(concat({every}))), x -> struct(element_at(array({names}), x.ord + 1) as kind, x.start as start, x.end as end))")
    return rows.select(*(F.col(f"row.`{c}`").alias(c) for c in own.columns), named.alias("spans"))


def redact(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets, and the length column, where there is one, set anew.

    Of spans that overlap, the first stands for all. Null stays null; repeated rows stay alike; an empty table stays empty; other
    columns stay as they are, whatever their names.
    """
    own = fresh(docs, "spans")
    found = find(docs.withColumnsRenamed({"spans": own}), text)
    new = F.expr(
        f"aggregate(spans, struct(0 as at, array('') as out), (a, x) -> if(x.end <= a.at, a, struct(x.end as at, concat(a.out, array(substring(`{text}`, a.at + 1, greatest(x.start - a.at, 0)),"
        f" if(x.start < a.at, '', concat('[', upper(x.kind), ']')))) as out)), a -> concat(array_join(a.out, ''), substring(`{text}`, a.at + 1)))"
    )
    out = found.withColumn(text, F.when(F.size("spans") > 0, new).otherwise(F.col(f"`{text}`")))
    if length in docs.columns:
        out = out.withColumn(length, F.when(F.size("spans") > 0, F.char_length(text)).otherwise(F.col(length)).cast(docs.schema[length].dataType))
    return out.drop("spans").withColumnsRenamed({own: "spans"}).select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each base kind and of added spans in every document, the digest of the base spans, and all spans."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = "array_join(transform({}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    is_base = ", ".join(f"'{k}'" for k in BASE)
    base = f"filter(spans, x -> x.kind in ({is_base}))"
    added = F.expr(f"cast(size(filter(spans, x -> x.kind not in ({is_base}))) as bigint)").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(F.expr(joined.format(base)), 256).alias("base_sha256"), F.expr(joined.format("spans")).alias("spans"), added, F.size("spans").cast("long").alias("n_spans"))
