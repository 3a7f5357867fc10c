"""Text rules as Column expressions. Unicode normalisation, which Spark lacks, is a call of a Java library that it brings along."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space as JavaScript's \s has it.
SPACE = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_U = "(?U)"
SPACES = "".join(map(chr, [*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
PUNCTUATION = "。、．，"

# Word lists and patterns of the rules.
GENERIC_THEMES = ["AI活用", "知識整理", "ツール開発", "AIとの対話", "AIの利用方法"]
LEAP_TERMS = ["リピートユーザー", "ユーザー獲得", "顧客獲得", "再利用率", "SaaS成長", "顧客維持", "組織の生産性"]
EXAGGERATIONS = ["劇的", "決定的", "飛躍的", "革新的", "大幅", "圧倒的"]
UNVERIFIABLE = ["劇的に改善する", "次のレベルへ進める", "決定的な洞察", "大きな価値を生む", "効果が非常に高い", "成功につながる可能性が高い"]
VAGUE_IDEAS = ["今後確認する", "今後確認する。", "使ってみる", "使ってみる。"]
WEAK_QUESTIONS = "検討する必要があるか|次のステップは何か|今後どうすればよいか|今後どう進めるか|何を優先すべきか|(必要|すべき)ですか[？?]?$"
PSYCHOLOGICAL = "恐れている|強く望んでいる|不安を感じ"
INNER_STATE = "ユーザーは.{0,24}(気づいた|と考えている|と感じている|と認識している)"
DENIED_CONCEPTS = ["今日", "質問", "相談", "重要", "方法"]
HONORIFIC = "(さん|くん|ちゃん|様)"
HONORIFIC_ALLOWED = ["皆さん", "みなさん"]
VERSUS, AND = "(^|\\s)[vV][sS](\\s|$)", "[\\p{IsHan}\\p{IsKatakana}A-Za-z0-9]{2}と[\\p{IsHan}\\p{IsKatakana}A-Za-z0-9]{2}"
EPISODIC = "を送って|セッティング|してください|してほしい|お願い|プレゼントや"
EPISODIC_WITH_PERSON = "誕生日|予定|メッセージ"
BROAD_SURFACES = ["気持ち", "こと", "状態", "関係"]
GENERIC_SURFACES = ["気持ち", "ツール", "テーマ", "データ", "高性能", "設計", "状態", "方法", "こと", "関係", "感じ"]
ADJECTIVES = ["論理的", "臨機応変", "高性能", "辛い", "怖い", "どうでもいい"]
CLAUSE_TAIL = "(すること|したい欲求|しんどい状況|状況|方法)$"
GRAMMATICAL = "^(を|が|は|て|に|と|で|こと|している|感じている)+$"
LONG_LABEL, MAX_ALIAS = 12, 16
#: Characters of the longest text of a list, and of the longest fixed end, at most.
MAX_LISTED = 16


#: Characters that no normal form changes and that compose with none of the others: ASCII, of NFC all below the combining marks, and the
#: common ranges of Japanese.
_CALM = r"\x{3001}\x{3002}\x{300C}\x{300D}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{30FC}\x{4E00}-\x{9FFF}"
#: Outlined letters and digits, which have forms since Unicode 16 only; these rules keep to 15.1.
NEWER = r"[\x{1CCD6}-\x{1CCF9}]"
_UNUSUAL = {"NFKC": rf"[^\x{{0}}-\x{{9F}}{_CALM}]", "NFC": rf"[^\x{{0}}-\x{{2FF}}{_CALM}]"}


def unusual(text: Column, form: str) -> Column:
    """The text if the normal form may change it, else null."""
    return F.when(text.rlike(_UNUSUAL[form]), text)


def _composed(text: Column, form: str) -> Column:
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(form == "NFKC"))


def _in_form(text: Column, form: str) -> Column:
    """Only texts that may change are put in the form, by the ICU library that Spark has for its collations; NEWER characters stay."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(f"{NEWER}+|{NEWER.replace('[', '[^')}+"), 0), lambda t: F.when(t.rlike(NEWER), t).otherwise(_composed(t, form)))
    return F.when(text.rlike(NEWER), F.array_join(parts, "")).when(text.rlike(_UNUSUAL[form]), _composed(text, form)).otherwise(text)


def trim(text: Column) -> Column:
    """Without white space at both ends, by the wide definition."""
    return F.regexp_replace(text, f"{_U}^{SPACE}+|{SPACE}+$", "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def nfkc(text: Column) -> Column:
    """Compatibility form."""
    return _in_form(text, "NFKC")


def nfc(text: Column) -> Column:
    return _in_form(text, "NFC")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, SPACES, " " * len(SPACES)), "  +", " "))


def concept_label(text: Column, normalised: bool = False) -> Column:
    return squeeze(text if normalised else nfkc(text))


def concept_key(text: Column, normalised: bool = False) -> Column:
    """Key by which concepts are equal: compatibility form, no white space, A-Z in lower case."""
    return F.translate(text if normalised else nfkc(text), UPPER + SPACES, LOWER)


def quote_text(text: Column, normalised: bool = False) -> Column:
    lines = F.regexp_replace(text, "\r\n?", "\n")
    return lines if normalised else nfc(lines)


def quote_found(content: Column, quote: Column) -> Column:
    """Whether the content has the quote, as it is or trimmed; blank quotes are not found."""
    return (trim(quote) != "") & (content.contains(quote) | content.contains(trim(quote)))


def compact(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def bare(text: Column) -> Column:
    """Without white space and Japanese punctuation."""
    return F.translate(text, SPACES + PUNCTUATION, "")


def has_any(text: Column, terms: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, terms)), lambda t: text.contains(t))


def _contains(text: Column, terms: Iterable[str]) -> Column:
    return reduce(Column.__or__, map(text.contains, terms))


def _if(guard: Column, rule: Column) -> Column:
    """The rule, which the guard's being false rules out; CASE doesn't try it then, even where it is a common expression."""
    return F.when(guard, rule).otherwise(guard)


def _listed(key: Callable[[Column], Column], text: Column) -> Column:
    """The key of a text, to compare with those of a list: of a long text only as much as tells that it is none of them."""
    first = key(F.substring(text, 1, 256))
    return F.when(F.length(first) > MAX_LISTED, first).otherwise(key(text))


def _tail(text: Column) -> Column:
    """What a pattern of a few fixed characters at the end has to see."""
    return F.substring(text, -MAX_LISTED, MAX_LISTED)


def is_weak_question(text: Column) -> Column:
    return (trim(text) == "") | trim(text).rlike(WEAK_QUESTIONS)


def is_generic_theme(text: Column) -> Column:
    return F.regexp_replace(compact(text), "[。．]", "").isin(GENERIC_THEMES)


def leaps_domain(claim: Column, evidence: Column) -> Column:
    return F.exists(F.array(*map(F.lit, LEAP_TERMS)), lambda t: claim.contains(t) & ~F.coalesce(evidence, F.lit("")).contains(t))


def near_duplicates(a: Column, b: Column) -> Column:
    a, b = bare(a), bare(b)
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def is_exaggerated(text: Column) -> Column:
    return has_any(text, EXAGGERATIONS)


def is_unverifiable(text: Column) -> Column:
    return has_any(text, UNVERIFIABLE)


def is_vague_idea(text: Column) -> Column:
    key = _listed(compact, text)
    return (key == "") | key.isin(VAGUE_IDEAS)


def is_psychological(text: Column) -> Column:
    return text.rlike(PSYCHOLOGICAL)


def asserts_inner_state(text: Column) -> Column:
    return text.rlike(INNER_STATE)


# Rules of concept labels; `label` is in the form of concept_label.


def _key(label: Column) -> Column:
    return concept_key(label, normalised=True)


def _list_key(label: Column) -> Column:
    return _listed(_key, label)


def is_denied(label: Column) -> Column:
    return _list_key(label).isin(DENIED_CONCEPTS)


def is_honorific(label: Column) -> Column:
    return _tail(label).rlike(f"{HONORIFIC}$") & ~label.isin(HONORIFIC_ALLOWED)


def has_honorific(label: Column) -> Column:
    found = F.regexp_extract_all(label, F.lit(f"{_U}([^\\s、。，]{{1,12}}{HONORIFIC})"), 1)
    return _if(_contains(label, HONORIFIC.strip("()").split("|")), F.size(F.array_except(found, F.array(*map(F.lit, HONORIFIC_ALLOWED)))) > 0)


def is_compound(label: Column) -> Column:
    return _contains(label, "×↔⇔") | _if(_contains(label, ["vs", "vS", "Vs", "VS"]), label.rlike(VERSUS)) | _if(label.contains("と"), label.rlike(AND))


def candidate_reason(label: Column) -> Column:
    """Why a label can't be a concept; null if it can."""
    return F.when(_list_key(label) == "", "empty").when(is_denied(label), "generic_term").when(is_compound(label), "compound_relation")


def is_long_clause(label: Column) -> Column:
    return (F.length(label) > MAX_ALIAS) | _contains(label, "。！？") | _tail(label).rlike("(のに|こと)$") & (F.length(label) > 8)


def is_episodic(label: Column) -> Column:
    return _contains(label, EPISODIC.split("|")) | _if(_contains(label, EPISODIC_WITH_PERSON.split("|")), has_honorific(label))


def is_divergent_alias(canonical: Column, alias: Column) -> Column:
    return (canonical != "") & (F.length(alias) > 8) & (F.length(alias) > F.length(canonical) * 2)


def alias_reason(alias: Column, canonical: Column | None = None) -> Column:
    """Why a label can't be an alias; null if it can."""
    out = F.when(_list_key(alias) == "", "empty").when(is_denied(alias), "generic_term").when(has_honorific(alias), "honorific_person").when(is_episodic(alias), "episodic_phrase").when(is_long_clause(alias), "long_clause")
    return out if canonical is None else out.when(is_divergent_alias(canonical, alias), "too_divergent")


def is_broad(label: Column) -> Column:
    return _list_key(label).isin(BROAD_SURFACES)


def is_generic_surface(label: Column) -> Column:
    return _list_key(label).isin(GENERIC_SURFACES)


def is_adjective(label: Column) -> Column:
    return _list_key(label).isin(ADJECTIVES)


def is_clause_like(label: Column) -> Column:
    n = F.length(label)
    return is_long_clause(label) | (n >= 5) & label.endswith("こと") | (n >= 8) & label.endswith("欲求") | (n >= 6) & _tail(label).rlike(CLAUSE_TAIL)


def _bigrams(key: Column) -> Column:
    return F.when(F.length(key) > 1, F.transform(F.sequence(F.lit(1), F.length(key) - 1), lambda i: F.substring(key, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def is_divergent(surface: Column, canonical: Column) -> Column:
    """Neither contains the other, and lengths are far apart or no two neighbouring characters are shared."""
    a, b, n, m = _key(surface), _key(canonical), F.length(surface), F.length(canonical)
    apart = (F.greatest(n, m) >= 4) & (F.greatest(n, m) >= F.least(n, m) * 1.8)
    return (a != "") & (b != "") & ~a.contains(b) & ~b.contains(a) & (apart | ~F.arrays_overlap(_bigrams(a), _bigrams(b)))


def is_over_general(surface: Column, canonical: Column) -> Column:
    """The surface ends with the canonical label, and what stands before it is more than grammar."""
    a, b = _key(surface), _key(canonical)
    at = F.call_function("locate", b, a)
    rest = F.concat(F.substring(a, F.lit(1), at - 1), F.substring(a, at + F.length(b), F.length(a)))
    enough = F.when(rest.endswith("の"), F.length(rest) >= 3).otherwise(F.length(rest) >= 2)
    return (a != "") & (b != "") & (a != b) & a.endswith(b) & (rest != "") & ~rest.rlike(GRAMMATICAL) & enough


def shorten(text: Column, n: int = 80) -> Column:
    first = squeeze(F.substring(text, 1, 4 * n))  # squeezed, the whole text begins with it
    return F.substring(F.when(F.length(first) >= n, first).otherwise(squeeze(text)), 1, n)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of an ASCII text."""
    step = lambda h, c: F.pmod(h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619), F.lit(4294967296))
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(2166136261).cast("long"), step)
