"""Language tags as Column expressions: Chinese script variants and what they satisfy. Null (inherit) and '' (unknown) stay apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossmill.functions import text

DEFAULT_TARGET = "zh-Hant"


def normal_tag(tag: Column) -> Column:
    """Lower case, trimmed, hyphens; null for an empty tag."""
    return F.nullif(F.translate(text.trimmed(F.lower(tag)), "_", "-"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def zh_variant(tag: Column) -> Column:
    """hant, hans, zh (bare), unknown; null where the tag isn't Chinese."""

    def subtags(parts: Column) -> Column:
        """What follows the language, up to a one-letter subtag, which begins an extension."""
        rest = F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))
        return let(rest, lambda r: let(F.array_position(F.transform(r, lambda p: F.length(p) == 1), True), lambda at: F.when(at > 0, F.slice(r, 1, (at - 1).cast("int"))).otherwise(r)))

    def named(own: Column) -> Column:
        region = F.get(F.filter(own, lambda p: p.isin("tw", "hk", "mo", "cn", "sg", "my")), F.lit(0))
        return (
            F.when(F.array_contains(own, "hant"), "hant")
            .when(F.array_contains(own, "hans"), "hans")
            .when(F.exists(own, lambda p: F.length(p) == 4), "unknown")
            .otherwise(let(region, lambda r: F.when(r.isin("tw", "hk", "mo"), "hant").when(r.isNotNull(), "hans").otherwise("unknown")))
        )

    return let(F.split(normal_tag(tag), "-", -1), lambda parts: F.when(F.get(parts, F.lit(0)) == "zh", F.when(F.size(parts) == 1, "zh").otherwise(let(subtags(parts), named))))


def satisfies(target: Column, lang: Column) -> Column:
    """Whether a variant may stand for a target variant: only Simplified for Simplified; Traditional or bare for either of these."""
    found = F.when(target == "hans", lang == "hans").when(target.isin("hant", "zh"), lang.isin("hant", "zh"))
    return F.coalesce(found, F.lit(False))


def page_is_target(page_lang: Column, sample: Column, target: Column) -> Column:
    """The page's own tag decides; without one, a sample with Han and without kana or Hangul counts as bare Chinese."""
    wanted = zh_variant(F.coalesce(F.nullif(target, F.lit("")), F.lit(DEFAULT_TARGET)))
    looks = text.has_han(sample) & ~text.has_kana_or_hangul(sample)
    found = F.when(normal_tag(page_lang).isNotNull(), zh_variant(page_lang)).when(looks, "zh")
    return F.coalesce(let(wanted, lambda w: satisfies(w, found)), F.lit(False))


def already_target(lang: Column, target: Column) -> Column:
    """Whether an element's own tag is the target's: by variant for a Chinese target, else by what precedes the first hyphen."""
    a, b = (F.nullif(text.trimmed(F.lower(tag)), F.lit("")) for tag in (lang, target))
    same = F.when(zh_variant(target).isNotNull(), let(zh_variant(target), lambda t: satisfies(t, zh_variant(lang)))).otherwise(F.substring_index(a, "-", 1) == F.substring_index(b, "-", 1))
    return F.coalesce(same, F.lit(False))


def insert_mode(kind: Column, is_button: Column, anchor_tag: Column, eff_lang: Column, source: Column, only_text: Column, target: Column) -> Column:
    """replace for short buttons and for Simplified text-only blocks under a Traditional target, else after-segment."""
    hant = let(zh_variant(target), lambda t: satisfies(t, F.lit("hant")))
    hans = F.coalesce(zh_variant(eff_lang) == "hans", F.lit(False))
    chinese = text.has_han(source) & ~text.has_kana_or_hangul(source)
    in_place = ~is_button & ~anchor_tag.isin("body", "html") & hant & hans & chinese & only_text
    return F.when(kind == "button", "replace").when(in_place, "replace").otherwise("after-segment")
