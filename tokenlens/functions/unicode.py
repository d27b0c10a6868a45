"""Scripts and blocks of the Unicode standard as sorted, disjoint ranges of code points.

Names are fixed values of the standard; their ranges are what the installed character database says, found by one search per name.
"""

from __future__ import annotations

from functools import lru_cache

#: Scripts, all that identify a character.
SCRIPTS = (
    "Adlam Ahom Anatolian_Hieroglyphs Arabic Armenian Avestan Balinese Bamum Bassa_Vah Batak Bengali Bhaiksuki Bopomofo Brahmi Braille Buginese Buhid "
    "Canadian_Aboriginal Carian Caucasian_Albanian Chakma Cham Cherokee Chorasmian Coptic Cuneiform Cypriot Cypro_Minoan Cyrillic Deseret Devanagari "
    "Dives_Akuru Dogra Duployan Egyptian_Hieroglyphs Elbasan Elymaic Ethiopic Georgian Glagolitic Gothic Grantha Greek Gujarati Gunjala_Gondi Gurmukhi Han "
    "Hangul Hanifi_Rohingya Hanunoo Hatran Hebrew Hiragana Imperial_Aramaic Inscriptional_Pahlavi Inscriptional_Parthian Javanese Kaithi Kannada Katakana "
    "Kawi Kayah_Li Kharoshthi Khitan_Small_Script Khmer Khojki Khudawadi Lao Latin Lepcha Limbu Linear_A Linear_B Lisu Lycian Lydian Mahajani Makasar "
    "Malayalam Mandaic Manichaean Marchen Masaram_Gondi Medefaidrin Meetei_Mayek Mende_Kikakui Meroitic_Cursive Meroitic_Hieroglyphs Miao Modi Mongolian "
    "Mro Multani Myanmar Nabataean Nag_Mundari Nandinagari New_Tai_Lue Newa Nko Nushu Nyiakeng_Puachue_Hmong Ogham Ol_Chiki Old_Hungarian Old_Italic "
    "Old_North_Arabian Old_Permic Old_Persian Old_Sogdian Old_South_Arabian Old_Turkic Old_Uyghur Oriya Osage Osmanya Pahawh_Hmong Palmyrene Pau_Cin_Hau "
    "Phags_Pa Phoenician Psalter_Pahlavi Rejang Runic Samaritan Saurashtra Sharada Shavian Siddham SignWriting Sinhala Sogdian Sora_Sompeng Soyombo "
    "Sundanese Syloti_Nagri Syriac Tagalog Tagbanwa Tai_Le Tai_Tham Tai_Viet Takri Tamil Tangsa Tangut Telugu Thaana Thai Tibetan Tifinagh Tirhuta Toto "
    "Ugaritic Vai Vithkuqi Wancho Warang_Citi Yezidi Yi Zanabazar_Square"
).split()
UNKNOWN = "<unknown_script>"
#: Blocks of the basic plane, and of others what texts hold most.
BLOCKS = (
    "Basic Latin|Latin-1 Supplement|Latin Extended-A|Latin Extended-B|IPA Extensions|Spacing Modifier Letters|Combining Diacritical Marks|Greek and Coptic|Cyrillic|"
    "Cyrillic Supplement|Armenian|Hebrew|Arabic|Syriac|Arabic Supplement|Thaana|NKo|Samaritan|Mandaic|Syriac Supplement|Arabic Extended-B|Arabic Extended-A|Devanagari|"
    "Bengali|Gurmukhi|Gujarati|Oriya|Tamil|Telugu|Kannada|Malayalam|Sinhala|Thai|Lao|Tibetan|Myanmar|Georgian|Hangul Jamo|Ethiopic|Ethiopic Supplement|Cherokee|"
    "Unified Canadian Aboriginal Syllabics|Ogham|Runic|Tagalog|Hanunoo|Buhid|Tagbanwa|Khmer|Mongolian|Unified Canadian Aboriginal Syllabics Extended|Limbu|Tai Le|"
    "New Tai Lue|Khmer Symbols|Buginese|Tai Tham|Combining Diacritical Marks Extended|Balinese|Sundanese|Batak|Lepcha|Ol Chiki|Cyrillic Extended-C|Georgian Extended|"
    "Sundanese Supplement|Vedic Extensions|Phonetic Extensions|Phonetic Extensions Supplement|Combining Diacritical Marks Supplement|Latin Extended Additional|Greek Extended|"
    "General Punctuation|Superscripts and Subscripts|Currency Symbols|Combining Diacritical Marks for Symbols|Letterlike Symbols|Number Forms|Arrows|Mathematical Operators|"
    "Miscellaneous Technical|Control Pictures|Optical Character Recognition|Enclosed Alphanumerics|Box Drawing|Block Elements|Geometric Shapes|Miscellaneous Symbols|Dingbats|"
    "Miscellaneous Mathematical Symbols-A|Supplemental Arrows-A|Braille Patterns|Supplemental Arrows-B|Miscellaneous Mathematical Symbols-B|"
    "Supplemental Mathematical Operators|Miscellaneous Symbols and Arrows|Glagolitic|Latin Extended-C|Coptic|Georgian Supplement|Tifinagh|Ethiopic Extended|"
    "Cyrillic Extended-A|Supplemental Punctuation|CJK Radicals Supplement|Kangxi Radicals|Ideographic Description Characters|CJK Symbols and Punctuation|Hiragana|Katakana|"
    "Bopomofo|Hangul Compatibility Jamo|Kanbun|Bopomofo Extended|CJK Strokes|Katakana Phonetic Extensions|Enclosed CJK Letters and Months|CJK Compatibility|"
    "CJK Unified Ideographs Extension A|Yijing Hexagram Symbols|CJK Unified Ideographs|Yi Syllables|Yi Radicals|Lisu|Vai|Cyrillic Extended-B|Bamum|Modifier Tone Letters|"
    "Latin Extended-D|Syloti Nagri|Common Indic Number Forms|Phags-pa|Saurashtra|Devanagari Extended|Kayah Li|Rejang|Hangul Jamo Extended-A|Javanese|Myanmar Extended-B|Cham|"
    "Myanmar Extended-A|Tai Viet|Meetei Mayek Extensions|Ethiopic Extended-A|Latin Extended-E|Cherokee Supplement|Meetei Mayek|Hangul Syllables|Hangul Jamo Extended-B|"
    "High Surrogates|High Private Use Surrogates|Low Surrogates|Private Use Area|CJK Compatibility Ideographs|Alphabetic Presentation Forms|Arabic Presentation Forms-A|"
    "Variation Selectors|Vertical Forms|Combining Half Marks|CJK Compatibility Forms|Small Form Variants|Arabic Presentation Forms-B|Halfwidth and Fullwidth Forms|Specials|"
    "Adlam|Mathematical Alphanumeric Symbols|Arabic Mathematical Alphabetic Symbols|Mahjong Tiles|Domino Tiles|Playing Cards|Enclosed Alphanumeric Supplement|"
    "Enclosed Ideographic Supplement|Miscellaneous Symbols and Pictographs|Emoticons|Ornamental Dingbats|Transport and Map Symbols|Alchemical Symbols|"
    "Geometric Shapes Extended|Supplemental Arrows-C|Supplemental Symbols and Pictographs|Chess Symbols|Symbols and Pictographs Extended-A|Symbols for Legacy Computing|"
    "CJK Unified Ideographs Extension B|CJK Unified Ideographs Extension C|CJK Unified Ideographs Extension D|CJK Unified Ideographs Extension E|"
    "CJK Unified Ideographs Extension F|CJK Compatibility Ideographs Supplement|CJK Unified Ideographs Extension G|Tags|Variation Selectors Supplement"
).split("|")


def _every(step: int) -> str:
    return "".join(map(chr, range(0, 0x110000, step)))


@lru_cache
def script_ranges() -> tuple[tuple[int, int, str], ...]:
    """(first, last, script), sorted; characters of scripts that have no name here are UNKNOWN, those of no script are in no range."""
    import regex

    every, out = _every(1), []
    for name in SCRIPTS:
        out += [(m.start(), m.end() - 1, name) for m in regex.finditer(rf"\p{{Script={name}}}+", every)]
    named = "".join(rf"\p{{Script={name}}}" for name in SCRIPTS)
    out += [(m.start(), m.end() - 1, UNKNOWN) for m in regex.finditer(rf"[^\p{{Script=Common}}\p{{Script=Inherited}}\p{{Script=Unknown}}{named}]+", every)]
    return tuple(sorted(out))


@lru_cache
def block_ranges() -> tuple[tuple[str, int, int], ...]:
    """(block, first, last), sorted by first; a block begins and ends at multiples of 16."""
    import regex

    every, out = _every(16), []
    for name in BLOCKS:
        m = regex.search(rf"\p{{Block={name}}}+", every)
        out.append((name, 16 * m.start(), 16 * m.end() - 1))
    return tuple(sorted(out, key=lambda x: x[1]))


def of_script(name: str) -> str:
    """A pattern for Java that fits one character of the script, by the ranges above."""
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b, script in script_ranges() if script == name) + "]"
