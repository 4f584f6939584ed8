"""Letters that look like Latin ones: other scripts by lists, small capitals by rule."""

import unicodedata

# Letters of other scripts, each with the Latin letter that it looks like.
CYRILLIC = "аa еe кk оo рp сc уy хx іi ѕs јj һh ԁd ԛq ԝw ѵv ӏl АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЅS ЈJ ҮY ԌG"
GREEK = "οo υu νv αa ιi κk ρp τt χx γy ωw ηn ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX"
ARMENIAN = "աw գq զq հh յj ոn սu ցg օo լl ՏS ՍU ՕO"
CHEROKEE = "ᎠD ᎡR ᎢT ᎥI ᎩY ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᎽY ᏀG ᏂH ᏃZ ᏏB ᏒR ᏔW ᏕS ᏙV ᏚS ᏞL ᏟC ᏢP ᏦK ᏧD ᏳG ᏴB"
COPTIC = "ⲀA ⲁa ⲂB ⲈE ⲉe ⲌZ ⲎH ⲒI ⲓi ⲔK ⲕk ⲘM ⲚN ⲞO ⲟo ⲢP ⲣp ⲤC ⲥc ⲦT ⲩy ⲨY ⲬX ⲭx ⳑl"
LATIN_LIKE = {p[0]: p[-1] for p in " ".join((CYRILLIC, GREEK, ARMENIAN, CHEROKEE, COPTIC)).split() if len(p) == 2}


def small_capitals() -> dict[str, str]:
    """Small capitals of the Latin alphabet and the letters that they are forms of, by their names."""
    out = {}
    for block in (range(0x250, 0x2B0), range(0x1D00, 0x1D80), range(0xA720, 0xA800)):
        for c in map(chr, block):
            head, _, letter = unicodedata.name(c, "").rpartition(" ")
            if head == "LATIN LETTER SMALL CAPITAL" and len(letter) == 1:
                out[c] = letter.lower()
    return out
