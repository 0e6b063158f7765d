"""Vocabulary of the domain.  Operators take a profile, so other languages can be served."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Profile:
    stopwords: tuple[str, ...]
    derivational: tuple[tuple[str, int], ...]  # (suffix, least length of a token that loses it)
    inflectional: tuple[tuple[str, int], ...]
    generic_words: tuple[str, ...]
    intents: dict[str, tuple[str, ...]]  # section type to cues, in order of precedence
    aliases: dict[str, tuple[str, ...]]  # prefix of a user's word to the corpus's words
    directory_cues: tuple[str, ...]
    municipality_groups: dict[str, tuple[str, ...]]
    form_synonyms: dict[str, tuple[str, ...]]
    list_sections: tuple[str, ...]
    openers: tuple[str, ...]
    anaphors: tuple[str, ...]
    continuations: tuple[str, ...]
    targeted: tuple[str, ...]
    enumerative: tuple[str, ...]
    abstain: tuple[str, ...]  # of scored answers
    clarify: tuple[str, ...]
    guard_abstain: tuple[str, ...]  # of replies that are about to be sent
    guard_request: tuple[str, ...]
    hard_abstention: str = ""
    negation: str = "не"
    labels: dict[str, str] = field(default_factory=dict)


# They decide results and are stated as given.
MACEDONIAN = Profile(
    stopwords=tuple("и на во со од за се да е дека а но или ли ќе го ја ги му им ни ме те по до при што кој која кое кои чиј ова овој оваа овие тоа тој таа тие не сум си сме сте се беше биле била било би".split()),
    derivational=(("ирање", 8), ("ување", 8), ("ација", 7)),
    inflectional=(("ите", 6), ("ови", 6), ("еви", 6), ("ата", 6), ("ото", 6), ("иот", 6), ("от", 5), ("та", 5), ("то", 5), ("те", 5), ("ов", 5), ("ев", 5), ("ја", 5), ("а", 5), ("и", 5), ("е", 5), ("о", 5)),
    generic_words=tuple("како каде кога колку кој која кои што дали може можам треба сакам имам ми нешто друго тоа ова".split()),
    intents={
        "documentsLocations": ("подигн", "преземањ", "презем", "подига"),
        "forms": ("образец", "обрасц", "формулар"),
        "tariffs": ("чин", "цена", "цени", "тариф", "надомест", "кошта", "плати", "чинат", "пари", "колку се плаќа", "колку плаќ"),
        "deadlines": ("рок", "колку време", "трае", "траење"),
        "documents": ("документ", "потребн", "прилож", "доказ", "што треба"),
        "access": ("онлајн", "интернет", "електронск", "плаќ", "плат"),
        "process": ("како", "постапк", "чекор", "начин", "кога", "каде"),
    },
    aliases={
        "машин": ("подвижни предмети",),
        "возил": ("подвижни предмети",),
        "фирм": ("субјект", "трговско друштво"),
        "регистрациј": ("упис", "основање"),
        "регистрир": ("упис", "основање"),
        "отвор": ("основање", "упис"),
        "гасењ": ("бришење", "ликвидација"),
        "затвор": ("бришење", "ликвидација"),
        "цена": ("тарифа", "надоместок"),
        "цени": ("тарифа", "надоместок"),
        "кошта": ("тарифа",),
    },
    directory_cues=("агент", "адвокат", "полномошн"),
    municipality_groups={"СКОПЈЕ": ("СКОПЈЕ", "ЦЕНТАР", "КАРПОШ", "АЕРОДРОМ", "ЧАИР", "ГАЗИ БАБА", "КИСЕЛА ВОДА", "БУТЕЛ", "ШУТО ОРИЗАРИ", "ЃОРЧЕ ПЕТРОВ", "САРАЈ")},
    form_synonyms={
        "ПДОО": ("поедноставено доо", "pdoo"),
        "ДОО, ДООЕЛ": ("друштво со ограничена одговорност", "doo", "dooel"),
        "АД": ("ad", "a.d.", "акционерско друштво"),
        "ТП": ("tp", "трговец поединец"),
        "Електронски": ("интернет", "преку интернет", "онлајн", "електронски", "по електронски пат", "дигитално"),
        "Web сервис": ("интернет", "преку интернет", "онлајн", "веб сервис", "web", "веб", "апликација"),
        "Хартиено на шалтер": ("шалтер", "на шалтер", "хартиено", "хартија", "лично", "во филијала"),
        "Хартиено": ("хартиено", "хартија", "на хартија", "печатено"),
    },
    list_sections=("process", "documents", "tariffs", "deadlines", "forms", "documentsLocations", "discounts", "instructions"),
    openers=tuple("а ама и ок добро значи па аха".split()),
    anaphors=tuple("тоа тој таа тие ова овој оваа овие истото истата истиот него неа нив таму тогаш".split()),
    continuations=("како пример", "за пример", "уште", "неколку", "повеќе", "друг пример", "останати", "сите други", "на пример"),
    targeted=("дали", "имам", "мојот", "мојата", "што точно", "со него"),
    enumerative=("кои", "сите", "наброј", "список", "колку", "каде"),
    abstain=("нема информација", "не располагам", "не се достапни", "не е достапна", "не е достапно", "не содржи", "не располага", "нема податоци", "не можам да најдам", "не постои информација"),
    clarify=("за каква правна форма", "која опција", "кој вариjант", "кој вид", "ве молам да ми кажете", "ве молам наведете", "на кој начин сакате", "за кој субјект", "прецизирајте"),
    guard_abstain=("нема информација", "немам информација", "не располагам", "не постои информација", "не е наведено", "нема податоци", "не можам да", "не се наведени", "не е достапен", "не е достапна", "не е достапно", "не се достапни"),
    guard_request=("потребен ми е", "потребна ми е", "потребно ми е", "потребни ми се", "ми е потребен", "ми е потребна", "ми е потребно", "ми треба"),
    hard_abstention="Во документацијата со која располагам нема информација за ова прашање.",
    labels={"process": "Постапка", "documents": "Потребни документи", "forms": "Обрасци", "tariffs": "Тарифи", "deadlines": "Рокови", "documentsLocations": "Начин на подигнување", "terminology": "Терминологија", "instructions": "Упатства", "discounts": "Попусти", "legalBasis": "Правен основ"},
)
