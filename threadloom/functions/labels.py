"""Labels of what pages show, as Column functions. A label that doesn't apply is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import percent

#: Labels.
KINDS = {"shift": "変化", "connection": "接続", "tension": "緊張関係"}
SPOTLIGHTS = {"shift": "考え方が変わっています", "connection": "新しいつながりがあります", "tension": "まだ揺れている問いがあります"}
RELATIONS = {"repetition": "繰り返し", "contrast": "対比", "complement": "補完", "progression": "進展"}
SUPPORTS = {"cross_session_interpretation": "AIによる横断的な解釈", "hypothesis": "まだ確認されていない仮説", "direct": "元発言から確認"}
OPEN_DIRECT = "過去Sessionで確認された問い"


def _named(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def percent_label(rate: Column) -> Column:
    return F.concat(percent(rate).cast("long").cast("string"), F.lit("%"))


def kind_label(kind: Column) -> Column:
    return _named(KINDS, kind)


def spotlight_label(kind: Column) -> Column:
    return _named(SPOTLIGHTS, kind)


def relation_label(relation: Column) -> Column:
    return _named(RELATIONS, relation)


def support_label(kind: Column, support: Column) -> Column:
    """Next questions have none, and a confirmed open question its own."""
    return F.when(support.isNull() | (kind == "nextQuestion"), None).when((kind == "openQuestion") & (support == "direct"), OPEN_DIRECT).otherwise(_named(SUPPORTS, support))


def evidence_metric(valid: Column, total: Column, rate: Column) -> Column:
    return F.when(total > 0, F.concat(F.lit("根拠 "), valid.cast("string"), F.lit("/"), total.cast("string"), F.lit("（"), percent_label(rate), F.lit("）")))


def interpretation_metric(valid: Column, total: Column, rate: Column) -> Column:
    """A missing rate is worked out; of no items it is 0."""
    valid = F.coalesce(valid, F.lit(0))
    rate = F.coalesce(rate, F.when(total == 0, 0.0).otherwise(valid / total))
    return F.when(total.isNotNull(), F.concat(F.lit("横断解釈 "), valid.cast("string"), F.lit("/"), total.cast("string"), F.lit("（"), percent_label(rate), F.lit("）")))


def hard_excluded(excluded: Column, items: Column, valid: Column) -> Column:
    return F.coalesce(excluded, items - valid)


def question_preview(question: Column, default: str, n: int = 48) -> Column:
    text = F.trim(F.coalesce(question, F.lit("")))
    return F.when(text == "", default).when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def selection_hint(n: Column) -> Column:
    """What a picker says while too few sessions are chosen for a review; null once they are enough."""
    return F.when(n == 0, "レビューするSessionを選んでください").when(n == 1, "統合レビューには2件以上のSessionが必要です")


def input_estimate(chars: Column, most: int) -> Column:
    """About how many characters a choice has, with the limit where it is over."""
    about = F.concat(F.lit("約 "), F.format_number(chars, 0), F.lit(" 文字"))
    return F.when(chars > most, F.concat(about, F.lit(f" / 上限 {most:,} 文字"))).otherwise(about)
