"""Normalising, tokenising and stop words as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

MAX_TERM = 50  # fixed value: longest term kept


def _plain_letters() -> tuple[str, str]:
    """Accented Latin letters and what they are without marks; n with a tilde stays."""
    found, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        ch = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if not 0x300 <= ord(c) <= 0x36F)
        if ch not in "ñÑ" and base != ch and len(base) == 1:
            found.append(ch)
            plain.append(base)
    return "".join(found), "".join(plain)


_MARKED, _PLAIN = _plain_letters()

# English stop words (fixed values); the tokeniser splits at apostrophes, so the parts are listed.
ENGLISH = (
    "a about above after again against ain all am an and any are aren as at be because been before being below between both but by can couldn d did didn do does "
    "doesn doing don down during each few for from further had hadn has hasn have haven having he her here hers herself him himself his how i if in into is isn it its "
    "itself just ll m ma me mightn more most mustn my myself needn no nor not now o of off on once only or other our ours ourselves out over own re s same shan she "
    "should shouldn so some such t than that the their theirs them themselves then there these they this those through to too under until up ve very was wasn we were "
    "weren what when where which while who whom why will with won wouldn y you your yours yourself yourselves"
).split()

# Spanish stop words without accents (fixed values): function words, then the forms of estar, haber, ser and tener.
SPANISH = (
    "de la que el en y a los del se las por un para con no una su al lo como mas pero sus le ya o este si porque esta entre cuando muy sin sobre tambien me hasta hay donde "
    "quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mi antes algunos unos yo otro otras otra tanto esa estos mucho quienes nada muchos "
    "cual poco ella estar estas algunas algo nosotros mis tu te ti tus ellas nosotras vosotros vosotras os mio mia mios mias tuyo tuya tuyos tuyas suyo suya suyos suyas "
    "nuestro nuestra nuestros nuestras vuestro vuestra vuestros vuestras esos esas estoy estamos estais estan estes estemos esteis esten estare estaras estara estaremos "
    "estareis estaran estaria estarias estariamos estariais estarian estaba estabas estabamos estabais estaban estuve estuviste estuvo estuvimos estuvisteis estuvieron "
    "estuviera estuvieras estuvieramos estuvierais estuvieran estuviese estuvieses estuviesemos estuvieseis estuviesen estando estado estada estados estadas estad he has ha "
    "hemos habeis han haya hayas hayamos hayais hayan habre habras habra habremos habreis habran habria habrias habriamos habriais habrian habia habias habiamos habiais "
    "habian hube hubiste hubo hubimos hubisteis hubieron hubiera hubieras hubieramos hubierais hubieran hubiese hubieses hubiesemos hubieseis hubiesen habiendo habido habida "
    "habidos habidas soy eres es somos sois son sea seas seamos seais sean sere seras sera seremos sereis seran seria serias seriamos seriais serian era eras eramos erais "
    "eran fui fuiste fue fuimos fuisteis fueron fuera fueras fueramos fuerais fueran fuese fueses fuesemos fueseis fuesen sintiendo sentido sentida sentidos sentidas siente "
    "sentid tengo tienes tiene tenemos teneis tienen tenga tengas tengamos tengais tengan tendre tendras tendra tendremos tendreis tendran tendria tendrias tendriamos "
    "tendriais tendrian tenia tenias teniamos teniais tenian tuve tuviste tuvo tuvimos tuvisteis tuvieron tuviera tuvieras tuvieramos tuvierais tuvieran tuviese tuvieses "
    "tuviesemos tuvieseis tuviesen teniendo tenido tenida tenidos tenidas tened"
).split()


def stop_words(language: str) -> list[str]:
    """Normalised stop words; a language without a list has none."""
    return sorted({"english": ENGLISH, "spanish": SPANISH}.get(language, ()))


def normalise(text: Column) -> Column:
    """Lower case without accents (n with a tilde stays), acronyms such as o.n.u. as one word."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), _MARKED.lower(), _PLAIN.lower())
    plain = F.regexp_replace(plain, "ñ", "ñ")
    plain = F.regexp_replace(plain, "[̀-ͯ]", "")
    # a dot goes if the sign before it stands alone and a single sign with a dot follows, or went before
    alone = r"(?<![\p{L}\p{N}_])"
    return F.regexp_replace(plain, rf"\.(?<={alone}[a-zñ]\.)(?=[a-zñ]\.)|\.(?<={alone}[a-zñ]\.[a-zñ]\.)", "")


def tokens(text: Column, language: str | None = None, stops: list[str] | None = None) -> Column:
    """Terms of a text in order: letters and digits, two signs or a digit, at most 50, no stop words."""
    found = F.regexp_extract_all(normalise(text), F.lit("([a-zñ0-9]+)"))
    kept = F.filter(found, lambda t: ((F.length(t) > 1) | t.rlike("^[0-9]$")) & (F.length(t) <= MAX_TERM))
    out = stop_words(language) if stops is None and language else stops or []
    if out:
        kept = F.filter(kept, lambda t: ~t.isin(out))
    return kept


def snippet(text: Column, terms: list[str], width: int = 160) -> Column:
    """The part of a text around its first term: width signs from a third before it, dots where it is cut."""
    folded = F.translate(F.lower(text), _MARKED.lower(), _PLAIN.lower())
    places = [F.when(F.locate(t, folded) > 0, F.locate(t, folded)) for t in terms if len(t) > 1]
    first = F.least(*places) if len(places) > 1 else places[0] if places else F.lit(None).cast("int")
    start = F.greatest(F.lit(0), first - 1 - width // 3)
    end = F.least(F.length(text), start + width)
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < F.length(text), "...").otherwise(""))
    head = F.concat(F.substring(text, 1, width), F.lit("..."))
    return F.when(F.length(text) <= width, text).when(first.isNull(), head).otherwise(cut)
