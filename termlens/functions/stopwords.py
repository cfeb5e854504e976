"""Stop-word lists (F10) and the punctuation / special-token sets.

The base English and German lists are the ones Spark ML ships for ``StopWordsRemover``, checked in as
text, so that neither the queries nor their SQL need a jar or a running JVM.
"""

from __future__ import annotations

import functools

# ---- fixed values (must equal the reference's) -------------------------------------------------
# Words added to / removed from the German list.
GERMAN_ADD = ["hätte", "wäre"]
GERMAN_REMOVE = [
    "kann", "kein", "keine", "keinem", "keinen", "keiner", "keines", "können", "könnte", "nicht",
    "nur", "noch", "sehr", "selbst", "sich", "soll", "sollte", "sonst", "sondern", "viel", "will",
    "wollen", "wollte", "doch", "durch",
]
# Base lists of Spark ML's ``StopWordsRemover``, in its order.
ENGLISH = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is
are was were be been being have has had having do does did doing a an the and but if or because as until
while of at by for with about against between into through during before after above below to from up
down in out on off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will just don should now
i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're
they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't
won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's
there's what's when's where's who's why's would
""".split()
GERMAN = """
aber alle allem allen aller alles als also am an ander andere anderem anderen anderer anderes anderm
andern anderr anders auch auf aus bei bin bis bist da damit dann der den des dem die das daß derselbe
derselben denselben desselben demselben dieselbe dieselben dasselbe dazu dein deine deinem deinen deiner
deines denn derer dessen dich dir du dies diese diesem diesen dieser dieses doch dort durch ein eine
einem einen einer eines einig einige einigem einigen einiger einiges einmal er ihn ihm es etwas euer
eure eurem euren eurer eures für gegen gewesen hab habe haben hat hatte hatten hier hin hinter ich mich
mir ihr ihre ihrem ihren ihrer ihres euch im in indem ins ist jede jedem jeden jeder jedes jene jenem
jenen jener jenes jetzt kann kein keine keinem keinen keiner keines können könnte machen man manche
manchem manchen mancher manches mein meine meinem meinen meiner meines mit muss musste nach nicht nichts
noch nun nur ob oder ohne sehr sein seine seinem seinen seiner seines selbst sich sie ihnen sind so
solche solchem solchen solcher solches soll sollte sondern sonst über um und uns unse unsem unsen unser
unses unter viel vom von vor während war waren warst was weg weil weiter welche welchem welchen welcher
welches wenn werde werden wie wieder will wir wird wirst wo wollen wollte würde würden zu zum zur zwar
zwischen
""".split()
# Special tokens of a BERT-style vocabulary.
SPECIAL_TOKENS = ["[SEP]", "[CLS]", "[PAD]"]
# Single-character punctuation tokens dropped from n-grams.
PUNCTUATION = list(".;:'\",!?-_=+§()[]/\\%#&")
# ------------------------------------------------------------------------------------------------


@functools.lru_cache(maxsize=None)
def stopwords_for(lang: str | None, german_variant: str = "modified") -> tuple[str, ...]:
    """Stop words for a language code: ``en``, ``de``; anything else has none."""
    if lang == "en":
        return tuple(ENGLISH)
    if lang == "de":
        words = list(GERMAN)
        if german_variant == "modified":
            words = [w for w in words if w not in set(GERMAN_REMOVE)] + [w for w in GERMAN_ADD if w not in words]
        return tuple(words)
    return ()


LANGUAGES_WITH_STOPWORDS = ("en", "de")


def sql_list(words) -> str:
    """Words as a SQL literal list body: ``'a', 'b'`` (quotes doubled)."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)
