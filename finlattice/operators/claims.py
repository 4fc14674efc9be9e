"""Claims: rule decomposition of answers, verification against contexts, and answers from what was verified.

The contexts of an answer are one array, whose numbers and lower-case texts are worked out once for each answer. Answers and
contexts meet before answers are cut into claims, so claims never shuffle; numbers and a formula's parts are only looked for
in claims of the types that need them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut
from .retrieval import dense_top_k

# Thresholds, formulas by the first keyword that occurs, and the refusal.
EXACT, FUZZY, SEMANTIC = 0.01, 0.05, 0.85
FORMULAS = [
    ("gross margin", "(revenue-cogs)/revenue"),
    ("operating margin", "operating_income/revenue"),
    ("net margin", "net_income/revenue"),
    ("profit margin", "net_income/revenue"),
    ("eps", "net_income/shares_outstanding"),
    ("debt ratio", "total_debt/total_assets"),
    ("current ratio", "current_assets/current_liabilities"),
]
TYPES = ["numerical", "comparative", "computational", "temporal", "entity", "regulatory"]
REFUSAL = "I cannot verify any claims from the retrieved context. I cannot provide a reliable answer."
VARIABLES = {
    "(revenue-cogs)/revenue": ["revenue", "cogs"],
    "operating_income/revenue": ["operating_income", "revenue"],
    "net_income/revenue": ["net_income", "revenue"],
    "net_income/shares_outstanding": ["net_income", "shares_outstanding"],
    "total_debt/total_assets": ["total_debt", "total_assets"],
    "current_assets/current_liabilities": ["current_assets", "current_liabilities"],
}


def _parts(text: Column) -> Column:
    return F.filter(F.split(T.strip(text), T.SENTENCE_END), lambda s: F.char_length(T.strip(s)) >= 10)


def _claims(text: Column) -> Column:
    """The sentences of _parts, each stripped."""
    return F.filter(F.transform(F.split(T.strip(text), T.SENTENCE_END), T.strip), lambda s: F.char_length(s) >= 10)


def sentences(answers: DataFrame, key: str = "answer_id") -> DataFrame:
    """key, claim_pos, text: sentences of at least ten characters, numbered from 0."""
    return answers.select(key, F.posexplode(_parts(F.col("text"))).alias("claim_pos", "text"))


def _typed(claims: DataFrame) -> DataFrame:
    """claims (text stripped) with their lower-case text, _l, type and flags."""
    return claims.withColumn("_l", F.lower("text")).withColumns({
        "claim_type": T.claim_type(F.col("text"), F.col("_l")),
        "has_numbers": F.regexp_like("text", F.lit(r"\d")),
        "has_dates": F.regexp_like("text", F.lit(T.DATE_HINT)),
    })


def decompose(answers: DataFrame, key: str = "answer_id") -> DataFrame:
    """The claims of each answer with type and flags."""
    return _typed(answers.select(key, F.posexplode(_claims(F.col("text"))).alias("claim_pos", "text"))).drop("_l")


def decompose_told(answers: DataFrame, key: str = "answer_id") -> DataFrame:
    """The claims of answers (key, text, response) as a model's JSON tells them, with type and flags.

    A claim has its `claim` text and its `type`. Where the response holds no array of such claims, or any of them names no
    text or a type that isn't one of TYPES, the answer is cut by the rules instead.
    """
    told = parse_claims(answers)
    fine = F.coalesce(F.forall("claims", lambda c: F.coalesce(c["claim"].isNotNull() & F.lower(c["type"]).isin(TYPES), F.lit(False))), F.lit(False))
    rule = F.transform(_claims(F.col("text")), lambda s: F.struct(s.alias("claim"), F.lit(None).cast("string").alias("type")))
    rows = told.select(key, F.posexplode(F.when(fine, F.col("claims")).otherwise(rule)).alias("claim_pos", "c"))
    typed = _typed(rows.select(key, "claim_pos", T.strip(F.col("c.claim")).alias("text"), F.lower("c.type").alias("_told")))
    return typed.withColumn("claim_type", F.coalesce("_told", "claim_type")).drop("_told", "_l")


def parse_claims(responses: DataFrame, column: str = "response") -> DataFrame:
    """Claims from a model's JSON answer: the first to last bracket, malformed text giving null (then use decompose)."""
    kind = "array<struct<claim:string,type:string>>"
    return responses.withColumn("claims", F.from_json(T.json_array(F.col(column)), kind))


def gather_contexts(contexts: DataFrame, key: str = "answer_id") -> DataFrame:
    """key and the array of its context texts in order."""
    rows = contexts.groupBy(key).agg(F.collect_list(F.struct("ctx_pos", "text")).alias("_c"))
    return rows.select(key, _texts("_c").alias("contexts"))


def _texts(rows: str) -> Column:
    """The texts of an array of contexts, in order."""
    return F.transform(F.sort_array(rows), lambda c: c["text"])


def nearest(claimed: Column, values: Column) -> Column:
    """The least relative distance of a value to the claimed one; null without values."""
    return F.array_min(F.transform(values, lambda v: F.abs(v - claimed) / F.greatest(claimed, F.lit(1.0))))


def first_hit(claimed: Column, values: Column) -> Column:
    """match, near or none by the first value within FUZZY of the claimed one, relative to it: an order-dependent check."""
    gap = lambda v: F.try_divide(F.abs(v - claimed), claimed)
    first = F.get(F.filter(values, lambda v: gap(v) < FUZZY), F.lit(0))
    return F.when(first.isNull(), "none").when(gap(first) < EXACT, "match").otherwise("near")


def formula_of(low: Column) -> Column:
    """The formula that a lower-case text names."""
    out = F.when(F.contains(low, F.lit(FORMULAS[0][0])), FORMULAS[0][1])
    for word, formula in FORMULAS[1:]:
        out = out.when(F.contains(low, F.lit(word)), formula)
    return out


def component(contexts: Column, variable: str) -> Column:
    """The first number after the variable's name, in the first context that has one."""
    pattern = f"(?i){variable.replace('_', ' ')}.*?({T.RAW_NUMBER})"
    values = F.transform(F.transform(contexts, lambda c: F.regexp_extract(c, pattern, 1)), T.primary_number)
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def _components(formula: Column, contexts: Column) -> Column:
    """The two parts of a known formula, found in the contexts; null for none. Nothing is ever evaluated as code."""
    out = None
    for name, variables in VARIABLES.items():
        parts = F.array(*[component(contexts, v) for v in variables])
        out = F.when(formula == name, parts) if out is None else out.when(formula == name, parts)
    return out


def _ratio(formula: Column, parts: Column) -> Column:
    """The value of a known formula from its parts."""
    a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.when(formula == "(revenue-cogs)/revenue", F.try_divide(a - b, a)).otherwise(F.try_divide(a, b))


def _verdict(ok: Column | bool, method: str | None, sure: float = 0.0) -> Column:
    return F.struct((F.lit(ok) if isinstance(ok, bool) else ok).alias("verified"), F.lit(method).cast("string").alias("method"), F.lit(sure).alias("confidence_after"))


def features(contexts: DataFrame, key: str = "answer_id") -> DataFrame:
    """key, contexts and what verification needs of them: _all, their numbers in order, and _low, their lower-case texts."""
    return gather_contexts(contexts, key).withColumns({"_all": F.flatten(F.transform("contexts", T.numbers)), "_low": F.transform("contexts", F.lower)})


def verify(claims: DataFrame, contexts: DataFrame, key: str = "answer_id", strict: bool = False) -> DataFrame:
    """claims with verified, method and confidence_after. contexts: key, ctx_pos, text.

    The rules are those of the claim's type. strict also checks the number of a temporal claim; the default doesn't.
    """
    joined = claims.join(features(contexts, key), key, "left").withColumn("_l", F.lower("text"))
    return _decided(joined, strict).select(*claims.columns, "verified", "method", "confidence_after")


def verify_answers(answers: DataFrame, contexts: DataFrame, key: str = "answer_id", strict: bool = False) -> DataFrame:
    """verify(decompose(answers), contexts), where answers and contexts meet before the claims are told apart. Adds evidence."""
    rows = _of_answers(answers.join(features(contexts, key), key, "left"), [key], strict, F.posexplode)
    return rows.select(key, "claim_pos", "text", "claim_type", "has_numbers", "has_dates", "verified", "method", "confidence_after", "evidence")


def _of_answers(both: DataFrame, kept: list[str], strict: bool, cut_up: Callable[[Column], Column]) -> DataFrame:
    """The verified claims of answers that stand beside their contexts' features, with the columns `kept`."""
    return _decided(_typed(both.select(*kept, "contexts", "_all", "_low", cut_up(_claims(F.col("text"))).alias("claim_pos", "text"))), strict)


def regenerate_known(answers: DataFrame, contexts: DataFrame, key: str = "answer_id") -> DataFrame:
    """regenerate for every key that has contexts: one without an answer, or whose answer has no claims, gives the refusal and no claims."""
    both = features(contexts, key).join(answers.select(key, "text").hint("merge"), key, "left")  # neither side is sent whole to the tasks
    return regenerate(_of_answers(both, [key], False, F.posexplode_outer), key)


def _decided(joined: DataFrame, strict: bool) -> DataFrame:
    """Claims with their answer's features, and what the rules make of them."""
    none = F.array().cast("array<string>")
    joined = joined.withColumns({"contexts": F.coalesce("contexts", none), "_low": F.coalesce("_low", none), "_all": F.coalesce("_all", F.array().cast("array<double>"))})
    kind, low = F.col("claim_type"), F.col("_l")
    measured = kind.isin("numerical", "temporal") if strict else kind == "numerical"
    joined = joined.withColumns({
        "_n": F.when(measured | (kind == "computational"), T.primary_number(F.col("text"))), "_p": F.when(kind == "comparative", T.percentage(F.col("text"))), "_d": F.when(kind == "temporal", T.date_text(F.col("text"))),
        "_f": F.when(kind == "computational", formula_of(low)),
    })
    joined = joined.withColumns({
        "_near": F.when(measured, nearest(F.col("_n"), F.col("_all"))), "_first": F.get("_all", F.lit(0)), "_second": F.get("_all", F.lit(1)), "_c": _components(F.col("_f"), F.col("contexts")),
    }).withColumn("_v", _ratio(F.col("_f"), F.col("_c")))
    n, near, first, second, value = F.col("_n"), F.col("_near"), F.col("_first"), F.col("_second"), F.col("_v")
    numerical = (
        F.when(n.isNull(), _verdict(False, "no_number_found"))
        .when(near.isNull(), _verdict(False, "numerical_no_match"))
        .when(near < EXACT, _verdict(True, "numerical_exact_match", 0.95))
        .when(near < FUZZY, _verdict(False, "numerical_near_match", 0.3))
        .otherwise(_verdict(False, "numerical_mismatch"))
    )
    growth = F.when(first == 0, F.lit(0.0)).otherwise((second - first) / F.abs(first))
    off = F.abs(growth - F.col("_p"))
    comparative = (
        F.when(second.isNull(), _verdict(False, "comparative_not_found"))
        .when(off < EXACT, _verdict(True, "comparative_calculated"))
        .when(off < FUZZY, _verdict(False, "comparative_near_match"))
        .otherwise(_verdict(False, "comparative_mismatch"))
    )
    way = F.when(F.contains(low, F.lit("increase")) | F.contains(low, F.lit("grew")), "up").when(F.contains(low, F.lit("decrease")) | F.contains(low, F.lit("declined")), "down")
    actual = F.when(second > first, "up").otherwise("down")
    directional = (
        F.when(second.isNull(), _verdict(False, "directional_not_found"))
        .when(way == actual, _verdict(True, "directional_verified", 0.8))
        .otherwise(_verdict(False, "directional_mismatch"))
    )
    gap = F.abs(value - n) / F.greatest(n, F.lit(1.0))
    computational = (
        F.when(F.col("_f").isNull(), _verdict(False, None))
        .when(F.get("_c", F.lit(0)).isNull() & F.get("_c", F.lit(1)).isNull(), _verdict(False, "computational_missing_components"))
        .when(value.isNull(), _verdict(False, "computational_error"))
        .when(n.isNull(), _verdict(False, None))
        .when(gap < EXACT, _verdict(True, "computational_verified", 0.9))
        .otherwise(_verdict(False, "computational_mismatch"))
    )
    seen = F.exists("_low", lambda c: F.contains(c, F.lower("_d")))
    temporal = F.when(F.col("_d").isNull(), _verdict(False, None)).when(seen, _verdict(True, "temporal_match", 0.85)).otherwise(_verdict(False, "temporal_not_found"))
    if strict:
        temporal = F.when(n.isNotNull() & (near >= EXACT), _verdict(False, "numerical_mismatch")).otherwise(temporal)
    known = F.exists("_low", lambda c: F.contains(c, low))
    generic = F.when(known, _verdict(True, "generic_keyword_match", 0.8)).otherwise(_verdict(False, "generic_not_found"))
    verdict = (
        F.when(kind == "numerical", numerical)
        .when(kind == "comparative", F.when(F.col("_p").isNull(), directional).otherwise(comparative))
        .when(kind == "computational", computational)
        .when(kind == "temporal", temporal)
        .otherwise(generic)
    )
    out = joined.withColumn("_r", verdict).withColumns({"verified": F.col("_r.verified"), "method": F.col("_r.method"), "confidence_after": F.col("_r.confidence_after")})
    closest = F.array_min(F.transform("_all", lambda v: F.struct(F.abs(v - n).alias("gap"), v.alias("v"))))["v"]
    plain = lambda c: F.round(c, 4).cast("decimal(28,4)").cast("string")
    evidence = (
        F.when(kind == "numerical", F.concat(F.lit("nearest number: "), plain(closest)))
        .when((kind == "comparative") & F.col("_p").isNotNull(), F.concat(F.lit("growth: "), plain(growth)))
        .when(kind == "comparative", F.concat(plain(first), F.lit(" -> "), plain(second)))
        .when(kind == "computational", F.concat(F.lit("computed: "), plain(value)))
        .when(kind == "temporal", F.concat(F.lit("date: "), F.col("_d")))
        .otherwise(F.get(F.filter("contexts", lambda c: F.contains(F.lower(c), low)), F.lit(0)))
    )
    return out.withColumn("evidence", evidence)


def verify_semantic(claims: DataFrame, contexts: DataFrame, key: str = "answer_id") -> DataFrame:
    """Generic claims by the best cosine of embedding columns; zero vectors and negative cosines never win.

    The best context of each claim is a dense search within its key, so pairs are never rows.
    """
    told = cut(claims.select(key, "claim_pos", "embedding").withColumn("question_id", F.monotonically_increasing_id()))
    shown = contexts.select(key, F.monotonically_increasing_id().alias("point_id"), F.col("embedding").alias("dense"))
    best = dense_top_k(told, shown, 1, ticker=key).select("question_id", F.col("score").alias("_s"))
    best = told.join(best, "question_id", "left").groupBy(key, "claim_pos").agg(F.greatest(F.lit(0.0), F.coalesce(F.max("_s"), F.lit(0.0))).alias("similarity"))
    sure = F.col("similarity") > SEMANTIC
    return best.withColumns({"verified": sure, "method": F.when(sure, "generic_semantic_match").otherwise("generic_no_semantic_match"), "confidence_after": F.when(sure, F.col("similarity")).otherwise(0.0)})


def verify_generic(claims: DataFrame, contexts: DataFrame, key: str = "answer_id") -> DataFrame:
    """Claims verified by the rules, but generic ones (entity, regulatory) by embeddings: both frames have a column `embedding`."""
    ruled = verify(claims.drop("embedding"), contexts.drop("embedding"), key)
    near = verify_semantic(claims.where(F.col("claim_type").isin("entity", "regulatory")).select(key, "claim_pos", "embedding"), contexts, key)
    near = near.select(key, "claim_pos", *[F.col(c).alias(f"_{c}") for c in ("verified", "method", "confidence_after")])
    both = ruled.join(near, [key, "claim_pos"], "left")
    return both.withColumns({c: F.coalesce(f"_{c}", c) for c in ("verified", "method", "confidence_after")}).drop("_verified", "_method", "_confidence_after")


def regenerate(verified: DataFrame, key: str = "answer_id") -> DataFrame:
    """key, answer, confidence, n_claims, n_verified: verified texts in claim order and their mean confidence, or the refusal.

    What a model makes of the verified claims is `regenerate_told`.
    """
    return _regenerated(verified, [key]).select(key, "answer", "confidence", "n_claims", "n_verified")


def _regenerated(verified: DataFrame, keys: list[str], beside: tuple[str, ...] = ()) -> DataFrame:
    """regenerate by several keys. beside: columns that all rows of a key agree on, kept."""
    kept = F.sort_array(F.collect_list(F.when(F.col("verified"), F.struct("claim_pos", "text", "confidence_after"))))
    rows = verified.groupBy(*keys).agg(kept.alias("_k"), F.count("claim_pos").alias("n_claims"), F.count_if("verified").alias("n_verified"), *[F.first(c).alias(c) for c in beside])
    none = F.size("_k") == 0
    total = F.aggregate("_k", F.lit(0.0), lambda s, c: s + c["confidence_after"])
    return rows.select(
        *keys, F.when(none, REFUSAL).otherwise(F.array_join(F.transform("_k", lambda c: c["text"]), " ")).alias("answer"),
        F.when(none, 0.0).otherwise(total / F.size("_k")).alias("confidence"), "n_claims", "n_verified", *beside,
    )


def payload(verified: DataFrame, key: str = "answer_id") -> DataFrame:
    """key, claims: the claims of each answer in order, as structs of text, type, verified, method and evidence."""
    one = F.struct("claim_pos", "text", F.col("claim_type").alias("type"), "verified", "method", "evidence")
    rows = verified.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("_c"))
    return rows.select(key, F.transform("_c", lambda c: F.struct(*[c[f].alias(f) for f in ("text", "type", "verified", "method", "evidence")])).alias("claims"))


def regenerate_told(verified: DataFrame, told: DataFrame, key: str = "answer_id") -> DataFrame:
    """regenerate, with the text of a model's response (told: key, response) and the confidence that it states.

    An answer without verified claims keeps the refusal, one whose model gave nothing the rules' text and confidence.
    """
    return _with_told(regenerate(verified, key).join(told.select(key, "response"), key, "left"))


def answer_told(answers: DataFrame, contexts: DataFrame, told: DataFrame, key: str = "answer_id") -> DataFrame:
    """regenerate_told(verify_answers(answers, contexts), told), where responses meet the answers first, so that what is made of claims is not sorted."""
    each = told.select(key, "response", F.monotonically_increasing_id().alias("_u"))
    both = answers.select(key, "text").join(each.hint("merge"), key, "left").join(features(contexts, key), key, "left")
    rows = _of_answers(both, [key, "_u", "response"], False, F.posexplode)
    return _with_told(_regenerated(rows, [key, "_u"], ("response",)).drop("_u"))


def _with_told(plain: DataFrame) -> DataFrame:
    use = (F.col("n_verified") > 0) & F.col("response").isNotNull()
    return plain.withColumns({"answer": F.when(use, F.col("response")).otherwise(F.col("answer")), "confidence": F.when(use, T.confidence(F.col("response"))).otherwise(F.col("confidence"))}).drop("response")
