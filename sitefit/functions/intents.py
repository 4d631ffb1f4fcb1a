"""What an utterance wants: word beginnings by intent, turned into patterns by one rule."""

from __future__ import annotations

#: Intent, beginnings of words of which one must occur, beginnings of which one must follow (none: nothing more is needed).
#: A trailing blank makes it the whole word. The first intent that fits counts, so narrow ones stand before wide ones.
WANTED = (
    ("norms", ("отключ", "выключ", "игнор", "ослаб", "без "), ("норм",)),
    ("question", ("почему ", "зачем ", "отчего ", "сколько "), ()),
    ("deselect", ("сними", "снять ", "сбро", "очист"), ("выдел", "выбор")),
    ("undo", ("отмен", "откат", "верни"), ()),
    ("violations", ("наруш", "несоответств"), ()),
    ("view3d", ("3d ", "объем", "трехмер"), ()),
    ("keep", ("не ",), ("удал", "убир", "убер", "трог")),
    ("delete", ("удал", "убер", "убир", "убра", "стер", "сотр", "снес", "выкин", "выброс", "вырез", "вырежь "), ()),
    ("select", ("выдел", "выбер", "выбра", "покаж"), ()),
    ("spacing", ("реже ", "пореже ", "гуще ", "погуще ", "чаще ", "почаще ", "плотн", "интервал", "шаг"), ()),
    ("rows", ("два ", "двумя ", "двухряд"), ("ряд",)),
    ("regenerate", ("генер", "сгенер", "перегенер", "пересчит", "перестро", "постро", "заново "), ()),
    ("help", ("помощ", "помог", "help ", "умеешь ", "можешь "), ()),
    ("greeting", ("привет", "здравств", "hello ", "hi "), ()),
    ("thanks", ("спасиб", "благодар", "thanks "), ()),
    ("bye", ("пока ", "удачи ", "прощай", "свидан"), ()),
)


def _one_of(starts: tuple[str, ...]) -> str:
    return r"\b(" + "|".join(s.strip() + r"\b" if s.endswith(" ") else s + r"\w*" for s in starts) + ")"


#: (pattern, intent) in the order of WANTED.
INTENT_RULES = tuple((_one_of(first) + (".*" + _one_of(then) if then else ""), intent) for intent, first, then in WANTED)
