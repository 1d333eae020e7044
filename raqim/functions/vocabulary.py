"""Fixed vocabularies of the domain, as values that results must equal."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arabic digits and their ASCII forms.
ARABIC_DIGITS, ASCII_DIGITS = "٠١٢٣٤٥٦٧٨٩", "0123456789"
#: Structural types without the article.
STRUCTURE_TYPES = ("قسم", "باب", "جزء", "فصل", "فرع", "مادة")
#: Ranks of the default profile and of the older one, which is compacted to the types present.
RANK = {"قسم": 0, "باب": 1, "جزء": 2, "فصل": 3, "فرع": 4, "مادة": 5}
LEGACY_RANK = {"قسم": 0, "جزء": 0, "باب": 1, "فصل": 2, "فرع": 3, "مادة": 4}
#: Ordinal words.
ORDINALS = {
    "الأول": "1", "الأولى": "1", "الثاني": "2", "الثانية": "2", "الثالث": "3", "الثالثة": "3", "الرابع": "4", "الرابعة": "4",
    "الخامس": "5", "الخامسة": "5", "السادس": "6", "السادسة": "6", "السابع": "7", "السابعة": "7", "الثامن": "8", "الثامنة": "8",
    "التاسع": "9", "التاسعة": "9", "العاشر": "10", "العاشرة": "10", "الحادي عشر": "11", "الحادية عشرة": "11",
    "الثاني عشر": "12", "الثانية عشرة": "12", "الثالث عشر": "13", "الثالثة عشرة": "13", "الرابع عشر": "14", "الرابعة عشرة": "14",
    "تمهيدي": "0", "تمهيدية": "0",
}
#: Month names.
MONTHS = {
    "يناير": 1, "فبراير": 2, "مارس": 3, "أبريل": 4, "ابريل": 4, "ماي": 5, "مايو": 5, "يونيو": 6, "يوليوز": 7, "يوليو": 7, "غشت": 8, "أغسطس": 8,
    "شتنبر": 9, "سبتمبر": 9, "أكتوبر": 10, "اكتوبر": 10, "نونبر": 11, "نوفمبر": 11, "دجنبر": 12, "ديسمبر": 12,
}
#: Header lines of scanned pages.
HEADER_LINES = ("مديرية التشريع والدراسات", "مديرية التشريع والدرامات", "وزارة العدل", "المملكة المغربية")
#: Entity types whose text is a name.
NAME_TYPES = ("PERSON", "JUDGE", "LAWYER", "COURT_CLERK", "ATTORNEY_GENERAL", "GOVERNMENT_BODY", "COURT", "AGENCY")
#: Relation types and their Arabic labels.
RELATION_LABELS = {
    "enacted_by": "صادر بمقتضى", "published_in": "نشر في", "effective_on": "ساري المفعول اعتبارًا من", "contains": "يضم",
    "approved_by": "صودق عليه من طرف", "signed_by": "وقعه", "amended_by": "عُدّل بواسطة", "implements": "يطبق", "decides": "يبت في",
    "judged_by": "حكم من طرف", "represented_by": "يمثل بواسطة", "clerk_for": "كاتب ضبط لدى", "prosecuted_by": "تابعته",
    "refers_to": "يشير إلى", "jumps_to": "يحيل على",
}
#: Context and completion limits of model families, the first prefix that fits.
MODEL_LIMITS = (("gpt-3.5-turbo-16k", 16_384, 12_000), ("gpt-3.5-turbo", 4_096, 3_000), ("gpt-4-turbo", 128_000, 4_000), ("gpt-4o", 128_000, 4_000), ("gpt-4", 8_192, 4_000))
DEFAULT_LIMITS = (16_384, 12_000)


def lookup(values: dict, key: Column) -> Column:
    """The value of ``key`` in a small fixed dictionary; NULL if it has none."""
    return F.create_map(*map(F.lit, chain.from_iterable(values.items())))[key]
