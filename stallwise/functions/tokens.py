"""Word tokens and stop lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# Words that do not name a product.
CARD_STOPWORDS = frozenset("""
the a an and or for to in on of by with module app apps manager management free pro ai advanced premium smart easy simple
best all new top ultimate complete
""".split())
# Further words that do not make a niche.
NICHE_STOPWORDS = CARD_STOPWORDS | frozenset("""
connector connectors integration integrations integrator tool tools system systems extension extensions plugin plugins
addon addons add ons auto automatic automation based multi single with without
""".split())
# Words left out of forum word counts.
FORUM_STOPWORDS = frozenset("""
the and for with this that have are was were from your you our their they will can but not all any about how what when
where which who why has had been being into onto over under just like more most some such only own same very off out get
got also too one two three need want using used use uses user users new old apps app module modules code thanks thank
please help anyone someone something nothing things able com www https http href rel nofollow link comment comments post
posts reddit.com r self automod amp x200b nbsp ive im dont didnt cant wont its hes shes thats whats theres heres whos
whose whom shall should would could might must may make made making takes taking took give giving gave try tried trying
gets getting see seen looking look first last next prev
""".split())
# Words left out of title terms.
TITLE_STOPWORDS = frozenset("""
the a an and or for to in on of by with is are was were be been being have has had do does did will would could should may
might this that these those i you he she it we they my your his her its our their from as at but if then else than so too
very just also only how what when where why who which whose whom tutorial video watch subscribe channel youtube shorts ep
episode part free demo review vs best top new all more less every no yes not make made use using used one two three first
second third
""".split())
# Fixed value: a word of a display name.
NAME_TOKEN = "[A-Za-z][A-Za-z0-9]+"
# Fixed value: a word of a forum post.
POST_TOKEN = "[a-zA-Z][a-zA-Z0-9_-]{3,}"


def words(c: str | Column, pattern: str = NAME_TOKEN) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))


def _kept(tokens: Column, stop: Iterable[str], min_len: int) -> Column:
    drop = sorted(stop)
    return F.filter(tokens, lambda t: ~F.lower(t).isin(drop) & (F.length(t) >= min_len))


def primary_keyword(name: str = "display_name", stop: Iterable[str] = CARD_STOPWORDS) -> Column:
    """First telling word of a name, else its first word."""
    tokens = words(name)
    return F.coalesce(F.try_element_at(_kept(tokens, stop, 3), F.lit(1)), F.try_element_at(tokens, F.lit(1)))


def niche_keyword(name: str = "display_name", stop: Iterable[str] = NICHE_STOPWORDS) -> Column:
    """First telling word of four letters or more, NULL without one."""
    return F.try_element_at(_kept(words(name), stop, 4), F.lit(1))


def title_terms(title: str = "title", stop: Iterable[str] = TITLE_STOPWORDS) -> Column:
    return _kept(F.transform(words(title), lambda t: F.lower(t)), stop, 3)
