"""Labelled spans for the tagger of pii.py, and its training.

    python -m karst.llm.pii_train TEXTS.parquet ... [--vocabulary FILE.tiktoken] [--steps N] [--seconds N] [--workers N]

Private data is invented here from common names, rules of word formation and public formats.
It is set into sentence frames and, as often, at any word boundary of background texts, so
that the tagger learns the form of an item and not its frame. Background sentences that look
as if they held private data are left out; look-alikes that are none are set in as well.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np

from karst.llm.charcrf import KINDS, Tagger, encode

#: Rows that a training reads at most from each table of background texts.
BACKGROUND_ROWS = 4000
#: Characters of a training window.
WINDOW = 112

_STEMS = (
    "Иван Петр Смирн Кузнец Попов Соколов Лебед Козл Новик Мороз Волк Алексе Павл Семен Голуб Виноград Богдан Воробь Федор Михайл Беля Тарас Белоус Титар Комар "
    "Орл Кисел Макар Андре Ковал Ильч Гус Тит Кузьм Кудряв Баран Кулик Степан Яковл Сорок Серге Роман Захар Борис Корол Герасим Пономар Григор Лазар Медвед Ерш "
    "Никит Собол Ряб Полян Цветк Данил Жук Фрол Журавл Никола Крыл Максим Сидор Осип Белк Матве Дорофе Егор Бел Лукьян Щерб Шестак Рогоз Зим Гонч Бондар Ткач Мельн"
).split()
_TAILS = "ов ов ов ев ев ёв ин ин ын ский ской цкий енко чук юк ук ко як ян дзе швили их ых ич ер ман штейн ейн айло ба ура ай".split()
_LATIN_LAST = (
    "Smith Johnson Brown Taylor Miller Wilson Moore Anderson Thomas Jackson White Harris Martin Thompson Garcia Martinez Robinson Clark Lewis Lee Walker Hall Allen "
    "Young King Wright Hill Scott Green Adams Baker Nelson Carter Mitchell Perez Roberts Turner Phillips Campbell Parker Evans Edwards Collins Stewart Murphy Schmidt "
    "Müller Weber Fischer Meyer Wagner Becker Hoffmann Dubois Laurent Moreau Rossi Russo Ferrari Novak Kowalski Nowak Horváth Jensen Nielsen Hansen Lindqvist Svensson"
).split()
_LATIN_TAILS = "son sen ton ley ford man berg stein wood field er ov ova in ina sky ski ic ich ez ini etti escu ell ard well".split()


@dataclass(frozen=True)
class Words:
    """Lists that a generator draws from; held-out tests bring others."""

    male: tuple[str, ...] = tuple(
        "Александр Дмитрий Максим Сергей Андрей Алексей Артем Илья Кирилл Михаил Никита Матвей Роман Егор Арсений Иван Денис Евгений Даниил Тимофей Владислав Игорь "
        "Владимир Павел Руслан Марк Константин Николай Степан Глеб Юрий Виктор Антон Олег Василий Борис Федор Григорий Семен Петр Лев Анатолий Валерий Вадим Виталий "
        "Станислав Вячеслав Геннадий Леонид Эдуард Аркадий Захар Савелий Тимур Родион Платон Назар Богдан Прохор Демид Климент Гордей Рустам Ильдар Ренат Фома Лука Савва".split()
    )
    female: tuple[str, ...] = tuple(
        "Анна Мария Елена Ольга Наталья Татьяна Ирина Екатерина Светлана Людмила Юлия Анастасия Галина Марина Валентина Дарья Надежда Вера Любовь Оксана Лариса "
        "Александра Ксения Алина Виктория Полина Алиса Евгения София Варвара Маргарита Кристина Вероника Диана Лидия Нина Тамара Зоя Раиса Яна Инна Жанна Эмма Милана "
        "Ульяна Василиса Кира Арина Елизавета Таисия Злата Есения Марфа Инга Регина Эльвира Гульнара Лилия Камилла Снежана Майя Ева Рената".split()
    )
    latin: tuple[str, ...] = tuple(
        "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Kenneth Joshua Kevin Brian George Edward "
        "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Kimberly Emily Donna Michelle Carol Amanda Melissa "
        "Hans Klaus Anna Marie Pierre Luc Sophie Giulia Marco José Ana Ivan Olga Dmitri Natalia Sven Ingrid Timur Odessa Tamsin Corwin Elspeth Jory Wendell Nadia Arthur".split()
    )
    stems: tuple[str, ...] = tuple(_STEMS)
    last: tuple[str, ...] = tuple(_LATIN_LAST)
    streets: tuple[str, ...] = tuple(
        "Централь Советск Молодежн Лесн Школь Садов Нов Набережн Заводск Зелен Полев Красн Московск Киевск Невск Большев Рабоч Северн Южн Западн Восточн Речн Озерн "
        "Луг Березов Вишнев Солнеч Горн Дальн Верхн Нижн Стар Почтов Вокзаль Железнодорож Партизанск Октябрьск Первомайск Парков Лугов Степн Песчан Каменн Кленов "
        "Сосн Рябинов Тих Светл Мирн Дач Клубн Студенческ Строитель Шахтерск Морск Портов Крайн Широк Моховая Янтар Ключев Родников".split()
    )
    owners: tuple[str, ...] = tuple("Ленина Гагарина Мира Победы Пушкина Кирова Чехова Гоголя Калинина Труда Космонавтов Строителей Жукова Мичурина Горького Свободы Дружбы Суворова Толстого Маяковского Энтузиастов".split())
    frames: dict[str, tuple[str, ...]] = field(default_factory=lambda: _FRAMES)
    background: tuple[str, ...] = ("текст без данных",)
    #: The same sentences as often as they stand, so that what every second row says is seen as often.
    common: tuple[str, ...] = ()
    #: Ordinary words, of which sentences without sense are made.
    lexicon: tuple[str, ...] = ()


_FRAMES: dict[str, tuple[str, ...]] = {
    "email": (
        "Напишите на {}.", "почта: {}", "E-mail: {}", "мой адрес {}", "Связаться можно по {}.", "Email me at {} today", "Send the file to {}.", "копия: {};", "<{}>", "mailto:{}", "({})", "Вопросы шлите на {}, отвечу завтра.", "логин {}", "Reply-To: {}",
        "Отправлено с {}", "contact {} for details", "ящик {} переполнен", "{}", "{}.", "Рассылка идет с {} каждую неделю.", "скиньте всё на {}!",
    ),
    "phone": (
        "Телефон: {}.", "тел. {}", "Звоните по номеру {}.", "call {}", "Phone: {}", "моб. {}", "my number is {}", "Наберите {} после обеда.", "мой номер {}", "Позвони мне: {}!", "т.: {}", "WhatsApp {}", "сот. {},", "перезвонить на {}", "{}", "({})", "{}.",
        "Reach me at {} after six.", "для связи {}", "Дозвониться можно по {} с утра.", "Факс и телефон {};", "mobile {}", "cell: {}", "tel {}", "tel: {}", "Контактный {}",
    ),
    "address": (
        "Адрес: {}.", "Живу по адресу {}.", "Доставка: {}", "Привезите по адресу: {}.", "прописан: {}", "Address: {}", "Ship to {}.", "I live at {}.", "Зарегистрирован по адресу {};", "Приезжайте к нам: {}.", "живу на {}", "проживающий: {}", "Забрать можно здесь: {}.", "{}",
        "{}.", "({})", "Мы переехали, теперь {}.", "Home: {}", "посылка на {}", "место жительства {}", "Встречаемся у дома: {}.",
    ),
    "name": (
        "Меня зовут {}.", "{} написал письмо.", "С уважением, {}", "Автор: {}", "ФИО: {}", "My name is {}.", "Regards, {}", "Пациентка {}", "Получатель {}, оплачено.", "Обращаться: {}.", "подпись: {}", "Звонил {}.", "Документ вернул {} вчера.", "{}",
        "{}.", "({})", "Report by {}", "Тут был {} и ушел.", "Signed: {}", "{}, добрый вечер!", "Dear {},", "Клиент {} ждет ответа", "это {} из бухгалтерии", "по словам {}, всё готово", "Передайте {} мои слова.", "Спасибо, {}!", "встретился с {}", "Ask {} about it.",
        "Заявитель — {}.", "Сведения о {} уточняются.", "{} и другие сотрудники", "Вчера {} уехал домой.", "Выдать на руки {}.", "the order was placed by {} online",
    ),
    "birth_date": ("{}", "{}.", "({})", "Заявитель {}.", "пациент, {}, обратился", "Анкета: {};", "клиент {} просит ответить", "Patient {}", "ребенок {}", "она {}"),
    "id_number": ("{}", "{}.", "({})", "Мои данные: {}.", "Укажите {} в форме.", "предъявил {}", "Для договора: {};", "my {} please", "Документ: {}", "в базе {} не найден", "Реквизиты — {}."),
}


class Maker:
    """Invents items and examples; the same seed gives the same ones."""

    def __init__(self, seed: int, words: Words) -> None:
        self.r, self.w = random.Random(seed), words

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def syllables(self, n: int, latin: bool = False) -> str:
        first, second = ("bcdfghjklmnprstvwz", "aeiouy") if latin else ("бвгджзклмнпрстфхцчш", "аеиоуыюя")
        parts = []
        for _ in range(n):
            parts.append((self.r.choice(first) if not self.chance(0.15) else self.r.choice(["st", "br", "tr", "sh", "th", "gr"] if latin else ["ст", "бр", "тр", "кр", "вл", "др"])) + self.r.choice(second))
        return "".join(parts)

    def surname(self) -> tuple[str, str]:
        """Masculine and feminine form."""
        stem = self.r.choice(self.w.stems) if self.chance(0.35) else (self.syllables(self.r.randint(1, 3)) + self.r.choice("бвгдзклмнпрсттх")).capitalize()
        tail = self.r.choice(_TAILS)
        if stem[-1] in "кгхц" and tail in ("ев", "ёв", "ын"):
            tail = "ов"
        stem = stem[:-2] if stem.endswith(tail[:2]) and len(stem) > 4 else stem
        he = stem + tail
        if tail in ("ский", "цкий", "ской"):
            return he, he[:-2] + "ая"
        if tail[-1] in "внё" and tail not in ("ян", "ман", "штейн", "ейн") and tail[-2] in "оеёиы":
            return he, he + "а"
        return he, he

    @staticmethod
    def _case(word: str, female: bool, case: int, family: bool) -> str:
        """Genitive, dative, instrumental or prepositional form (1 to 4) by the ending."""
        end = word[-1]
        if family and female:
            if word.endswith("ая"):
                return word[:-2] + "ой"
            return word[:-1] + "ой" if end == "а" and word[-2] in "вн" else word
        if family and word.endswith(("ий", "ой")):
            return word[:-2] + ("ого", "ому", "им", "ом")[case - 1]
        if end in "ая" and not family:
            stem, soft = word[:-1], end == "я"
            return stem + ("и" if soft or stem[-1] in "гкхжшчщ" else "ы", "и" if stem.endswith("и") else "е", "ей" if soft else "ой", "и" if stem.endswith("и") else "е")[case - 1]
        if end == "ь":
            return word[:-1] + (("и", "и", "ью", "и") if female else ("я", "ю", "ем", "е"))[case - 1]
        if female or end in "аоеёиуыэюях":
            return word
        if end == "й":
            return word[:-1] + ("я", "ю", "ем", "е")[case - 1]
        last = "ым" if family and word[-2:] in ("ов", "ев", "ёв", "ин", "ын") else "ом"
        return word + ("а", "у", last, "е")[case - 1]

    @staticmethod
    def patronymic(father: str, female: bool) -> str:
        stem = father[:-1] if father[-1] in "айьяю" else father
        if father[-1] in "ая":
            return stem + ("инична" if female else "ич")
        soft = father[-1] in "йь"
        stem = stem[:-1] + "ь" if father.endswith("ий") and stem[-1] == "и" and len(stem) > 4 else stem
        return stem + (("евна" if soft else "овна") if female else ("евич" if soft else "ович"))

    def name(self) -> str:
        r, w = self.r, self.w
        if self.chance(0.34):
            first = r.choice(w.latin) if self.chance(0.55) else self.syllables(2, True).capitalize()
            last = r.choice(w.last) if self.chance(0.3) else (self.syllables(r.randint(1, 3), True) + r.choice(["", *"bdklmnprstv"]) + (r.choice(_LATIN_TAILS) if self.chance(0.6) else r.choice(["", self.syllables(1, True), *"nrsltk"]))).capitalize()
            if self.chance(0.05):
                last = r.choice(["Mc", "O'", "De ", "von ", "van "]) + last
            mid = r.choice(w.latin)
            return r.choice([f"{first} {last}"] * 8 + [f"{last} {first}", f"{last}, {first}", f"{first[0]}. {last}", f"{first[0]}. {mid[0]}. {last}", f"{first} {mid[0]}. {last}", f"{first} {mid} {last}", f"{last} {first[0]}.", f"{first} {last}-{r.choice(w.last)}"])
        female = self.chance(0.5)
        first = r.choice(w.female if female else w.male) if self.chance(0.82) else self.syllables(r.randint(2, 3)).capitalize()
        last, father = self.surname()[female], r.choice(w.male)
        if self.chance(0.04):
            last += "-" + self.surname()[female]
        mid, i, j = self.patronymic(father, female), first[0], father[0]
        if self.chance(0.25):
            case = r.randint(1, 4)
            first, last = self._case(first, female, case, False), self._case(last, female, case, True)
            mid = mid[:-1] + ("ы", "е", "ой", "е")[case - 1] if female else mid + ("а", "у", "ем", "е")[case - 1]
        short = r.choice([f"{i}.{j}.", f"{i}. {j}."])
        return r.choice(
            [f"{first} {last}"] * 5 + [f"{last} {first}"] * 3 + [f"{first} {mid} {last}"] * 3 + [f"{last} {first} {mid}"] * 3
            + [f"{last} {short}", f"{short} {last}", f"{short}{last}", f"{short} {last}"] * 3 + [f"{i}. {last}", f"{last} {i}.", f"{last}, {first}", f"{last} {i}{j}"[: None if self.chance(0.2) else -3] + f" {short}"]
        )

    def phone(self) -> str:
        r, d = self.r, self.digits
        a, b, c, e = d(3), d(3), d(2), d(2)
        h = r.choice(["-", "-", "–", "‑", " "])
        head = r.choice(["+7", "8", "+7", "8", "7", "+ 7", "+375", "+380", "+49", "+33"])
        base = r.choice([
            f"{head} ({a}) {b}{h}{c}{h}{e}", f"{head}({a}){b}{h}{c}{h}{e}", f"{head}({a}){b}{c}{e}", f"{head} {a} {b}{h}{c}{h}{e}", f"{head} {a} {b} {c} {e}", f"{head}{a}{b}{c}{e}", f"{head}{a}{b}{c}{e}", f"8{a}{b}{c}{e}", f"8{a}{b}{c}{e}", f"8{a}{b}{c}{e}", f"8{a}{b}{c}{e}", f"7{a}{b}{c}{e}", f"+7{a}{b}{c}{e}", f"{head}.{a}.{b}.{c}.{e}",
            f"{head}-{a}-{b}-{c}-{e}", f"{head} {a}-{b}-{c}{e}", f"{head} ({a}) {b}{c}{e}", f"{head} ({a}{c[0]}) {b[:2]}{h}{c}{h}{e}", f"({a}) {b}{h}{c}{h}{e}", f"8 {a} {b}{c}{e}", f"{head}{a} {b}{h}{c}{h}{e}", f"{head} [{a}] {b} {c} {e}",
            f"+1 ({a}) {b}-{c}{e}", f"+1-{a}-{b}-{c}{e}", f"+1 {a} {b} {c}{e}", f"({a}) {b}-{c}{e}", f"+44 {d(4)} {d(6)}", f"+44 {d(2)} {d(4)} {d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"00{d(2)} {a} {b} {c}{e}", f"+{d(2)} {a} {b} {c} {e}", f"+{d(2)} {d(2)} {d(3)} {d(2)} {d(2)}",
            "{} {}".format(r.choice(["8", "+7"]), " ".join(a + b + c + e)),
        ])
        return base + (r.choice([", доб. ", " доб. ", " ext. ", " доб ", " (доб. "]) + d(r.randint(2, 4)) if self.chance(0.08) else "")

    def local_phone(self) -> tuple[str, str]:
        d, h = self.digits, self.r.choice("- –")
        return self.r.choice(["тел. ", "телефон ", "тел.: ", "звоните ", "phone ", "Телефон: ", "дом. тел. "]), self.r.choice([f"{d(3)}{h}{d(2)}{h}{d(2)}", f"{d(2)}{h}{d(2)}{h}{d(2)}", f"{d(3)}-{d(4)}"])

    def email(self) -> str:
        r, w = self.r, self.w
        part = lambda: r.choice([self.syllables(r.randint(1, 3), True), r.choice(w.latin).lower(), r.choice(w.last).lower(), self.syllables(2, True) + r.choice("nrstkl")])
        user = r.choice([part(), part(), part() + "." + part(), part() + "_" + part(), part() + "+" + part(), part() + "-" + part(), part() + self.digits(r.randint(1, 4)), part()[0] + "." + part()])
        host = r.choice([part(), part() + part(), part() + self.digits(2), part() + "-" + part(), "mail", "gmail", "yandex", "mail." + part(), "example", "corp." + part(), part() + "." + part()])
        top = r.choice("ru com org net test example invalid edu info рф su io de dev co.uk com.ru".split())
        form = r.random()
        if form < 0.14:
            gap = r.choice([" ", " ", "  "])
            return gap.join([user, r.choice(["собака", "собачка", "at", "(собака)", "[собака]", "(at)", "[at]", "{at}", "<at>"]), host.replace(".", " точка "), r.choice(["точка", "dot", "(точка)", "[точка]", "(dot)", "[dot]", "."]), top.replace(".", " точка ")])
        if form < 0.22:
            at, dot = r.choice([(" (at) ", " (dot) "), (" [at] ", " [dot] "), (" (собака) ", " (точка) "), (" at ", " dot "), ("(at)", "(dot)")])
            return f"{user}{at}{host.replace('.', dot)}{dot}{top.replace('.', dot)}"
        if form < 0.28:
            at, dot = r.choice([("(at)", "(dot)"), ("[at]", "[dot]"), ("(at)", "."), ("[at]", "."), (" at ", " dot "), (" (a) ", "."), (" @ ", "."), (" собака ", "."), ("(собака)", "(точка)")])
            return f"{user}{at}{host}{dot}{top}"
        mail = f"{user}@{host}.{top}"
        return mail.upper() if form < 0.32 else mail.title() if form < 0.35 else mail

    def id_number(self) -> tuple[str, str]:
        """Words before, and the number."""
        r, d = self.r, self.digits
        sep = r.choice([" ", " ", ": ", " № ", " N ", " — ", " - ", ", номер ", " номер "])
        snils = f"{d(3)}-{d(3)}-{d(3)}{r.choice([' ', ' ', '-'])}{d(2)}"
        before, number = r.choice([
            ("", snils), ("", snils), ("", snils), ("", snils), ("СНИЛС", snils), ("СНИЛС", snils), ("СНИЛС", d(11)), ("СНИЛС", f"{d(3)} {d(3)} {d(3)} {d(2)}"), ("страховое свидетельство", snils), ("страховой номер", snils),
            ("паспорт", f"{d(4)} {d(6)}"), ("паспорт", f"{d(2)} {d(2)} {d(6)}"), ("паспорт", f"{d(4)} № {d(6)}"), ("паспорт", f"серия {d(2)} {d(2)} № {d(6)}"), ("паспорт", f"серия {d(4)} номер {d(6)}"), ("паспорт", f"серии {d(4)} номер {d(6)}"), ("паспорт РФ", f"{d(4)} {d(6)}"), ("Паспортные данные", f"{d(4)} {d(6)}"),
            ("загранпаспорт", f"{d(2)} {d(7)}"), ("загранпаспорт", f"{d(2)} № {d(7)}"), ("passport", f"{d(2)} {d(7)}"), ("passport", d(9)), ("passport no.", d(9)), ("passport number", f"{r.choice('ABCEGKNPX')}{d(8)}"), ("серия и номер", f"{d(4)} {d(6)}"),
            ("ИНН", d(12)), ("ИНН", d(12)), ("ИНН", f"{d(4)} {d(4)} {d(4)}"), ("ИНН", f"{d(4)} {d(6)} {d(2)}"), ("tax id", d(12)), ("налоговый номер", d(12)), ("TIN", f"{d(3)}-{d(2)}-{d(4)}"), ("ИНН физлица", d(12)),
            ("SSN", f"{d(3)}-{d(2)}-{d(4)}"), ("", f"{d(3)}-{d(2)}-{d(4)}"), ("", f"{d(3)}-{d(2)}-{d(4)}"), ("SSN", f"000-{d(2)}-{d(4)}"), ("SSN", f"{d(3)}-{d(2)}-{d(4)}"), ("social security", f"{d(3)}-{d(2)}-{d(4)}"), ("social security number", f"{d(3)} {d(2)} {d(4)}"), ("SSN", d(9)),
            ("полис ОМС", d(16)), ("полис", d(16)), ("полис ОМС", f"{d(4)} {d(4)} {d(4)} {d(4)}"), ("ОМС", d(16)), ("медицинский полис", d(16)), ("health policy", d(16)), ("страховой полис", f"{d(4)} {d(4)} {d(4)} {d(4)}"), ("полис обязательного страхования", d(16)),
        ])
        return (before + sep if before else ""), number

    def street(self, end: str) -> str:
        if end == "":
            draw = self.r.random()
            if draw < 0.5:
                return self.r.choice(self.w.owners)
            return self._case(self.surname()[0], False, 1, True) if draw < 0.85 else self._case(self.r.choice(self.w.male), False, 1, False) + " " + self._case(self.surname()[0], False, 1, True)
        stem = self.r.choice(self.w.streets) if self.chance(0.5) else (self.syllables(self.r.randint(1, 3)) + self.r.choice(["н", "ск", "в", "льн", "чн", "ов"])).capitalize()
        return stem + ("н" if stem[-1] not in "нскв" else "") + end

    def town(self) -> str:
        return self.r.choice([self.syllables(self.r.randint(2, 3)).capitalize() + self.r.choice(["", "", "ск", "град", "во", "но"]), "Москва", "Казань", "Пермь", "Тула", "Омск", self.r.choice(["Нижний ", "Старый ", "Новый "]) + self.syllables(2).capitalize() + "ск"])

    def address(self) -> str:
        r, d = self.r, self.digits
        n, k, f = str(r.randint(1, 250)) + (r.choice(["а", "б", "А", "к2", "/3", ""]) if self.chance(0.15) else ""), r.randint(1, 12), r.randint(1, 400)
        she, he, of, it = self.street("ая"), self.street("ый"), self.street(""), self.street("ой")
        house = r.choice([f", д. {n}", f", {n}", f", дом {n}", f" {n}", f", д.{n}", f" д {n}", f", владение {n}", f", дом №{n}", f", д. № {n}"])
        rest = r.choice(["", "", "", f", кв. {f}", f", квартира {f}", f", к. {k}", f" корп. {k}", f", корпус {k}, кв. {f}", f", стр. {k}", f" кв {f}", f"-{f}", f", подъезд {k}", f", офис {f}"])
        which = r.random()
        if which < 0.7:
            kind = r.random()
            if kind < 0.45:
                core = r.choice([f"ул. {she}", f"улица {she}", f"{she} улица", f"{she} ул.", f"ул {she}", f"ул. {of}", f"улица {of}", f"ул. {of}", f"наб. {she}", f"набережная {of}", f"пл. {of}", f"площадь {of}", f"аллея {of}", f"линия {she}"])
            elif kind < 0.75:
                core = r.choice([f"проспект {he}", f"пр-т {of}", f"пр. {of}", f"пр-кт {he}", f"{he} проспект", f"переулок {he}", f"пер. {he}", f"{he} переулок", f"{he} пер.", f"бульвар {of}", f"б-р {of}", f"шоссе {he[:-2]}ое", f"проезд {he}", f"{he} пр-д", f"тупик {he}", f"микрорайон {he}", f"пр-д {of}"])
            else:
                core = r.choice([f"улице {it}", f"{it} улице", f"улице {of}", f"{it}", f"улицы {it}", f"проспекте {of}", f"{he[:-2]}ом переулке", f"{he[:-2]}ом проспекте", f"бульваре {of}"])
                house = r.choice([f", дом {n}", f", д. {n}"]) if core == it else house  # without a word for street, the house has one
            core += house + rest
            if self.chance(0.12):  # hardly any punctuation
                return f"{r.choice(['ул', 'улица', 'пер', 'проспект', 'ул'])} {r.choice([she, of, she])} {r.choice(['', '', 'д ', 'дом '])}{n}{r.choice(['', f' кв {f}', f' кв {f}', f' {f}', f' к {k} кв {f}'])}"
            if self.chance(0.1):
                core = r.choice([f"дом {n} по {it} улице", f"дом {n} по улице {of}", f"д. {n} на улице {it}", f"дом {n}, {she} улица", f"дом {n} на {it}"])
            elif self.chance(0.35):
                core = r.choice([f"г. {self.town()}, ", f"{self.town()}, ", f"{d(6)}, {self.town()}, ", f"{d(6)}, г. {self.town()}, ", f"город {self.town()}, ", f"{d(6)} {self.town()} ", f"пос. {self.town()}, ", f"{self.town()} "]) + core
            return core
        base = self.syllables(r.randint(1, 2), True).capitalize() + r.choice(["", "n", "ford", "ley", "ton", "wood", "field"]) if self.chance(0.6) else r.choice(self.w.last + ("Oak", "Maple", "Main", "Park", "Church", "High", "Mill", "Station", "Elm", "Lake", "River", "King's"))
        if which < 0.9:
            core = f"{n} {r.choice(['', '', 'North ', 'Old ', 'West '])}{base} " + r.choice("Lane Street St. St Road Rd Avenue Ave Drive Dr. Court Place Square Boulevard Way Close Terrace Crescent".split())
            core += r.choice(["", "", f", Apt {f}", f", Apt. {f}", f", flat {f}", f" #{f}", f", Unit {k}", f", Suite {f}"])
            return core + (f", {self.syllables(2, True).capitalize()}" if self.chance(0.15) else "")
        return r.choice([f"{base}straße {n}", f"{base}strasse {n}", f"{base}weg {n}", f"{n} rue de {base}", f"{n}, rue {base}", f"{n} avenue de {base}", f"Via {base} {n}", f"Via {base}, {n}", f"Calle {base} {n}", f"Calle {base}, {n}", f"{base}gasse {n}", f"rue {base} {n}", f"ul. {base} {n}"])

    def date(self) -> str:
        r = self.r
        s = r.choice("...//--")
        d, m, y = r.randint(1, 28), r.randint(1, 12), r.randint(1920, 2015)
        ru, en = _MONTHS[m - 1], _MONTHS_EN[m - 1]
        return r.choice(
            [f"{d:02}{s}{m:02}{s}{y}"] * 7 + [f"{d}{s}{m}{s}{y}", f"{y}-{m:02}-{d:02}", f"{y}-{m:02}-{d:02}", f"{y}.{m:02}.{d:02}", f"{d:02}{s}{m:02}{s}{y % 100:02}", f"{d:02} {m:02} {y}", f"{d:02}. {m:02}. {y}"]
            + [f"{d} {ru} {y}", f"{d} {ru} {y}", f"{d} {ru} {y} года", f"{d} {ru} {y} г.", f"«{d}» {ru} {y}"] + [f"{d} {en} {y}", f"{en} {d}, {y}", f"{en[:3]} {d}, {y}", f"{d} {en[:3]} {y}", f"{en} {d}{'th' if 3 < d < 21 else 'st' if d % 10 == 1 else 'nd' if d % 10 == 2 else 'rd' if d % 10 == 3 else 'th'}, {y}"]
        )

    def birth(self) -> tuple[str, str, str]:
        before, after = self.r.choice(_BIRTH)
        if self.chance(0.08):  # a place or a name between
            before += self.r.choice(["в ", "in "]) + self.town() + " "
        return before, self.date(), after

    def alike(self) -> str:
        """What looks like private data and is none."""
        r, d = self.r, self.digits
        he, she = self.surname()
        first, of = r.choice(self.w.male), self._case(he, False, 1, True)
        named = r.choice([of, f"{self._case(first, False, 1, False)} {of}", f"{first[0]}. {r.choice(self.w.male)[0]}. {of}", f"{first[0]}.{r.choice(self.w.male)[0]}. {of}", f"{r.choice(self.w.male)[0]}. {of}", self._case(she, True, 1, True)])
        latin = f"{r.choice(self.w.latin)} {r.choice(self.w.last)}"
        noun = r.choice(_INSTITUTIONS)
        she_s, he_s, of_s = self.street("ая"), self.street("ый"), self.street("")
        adj = self.street(r.choice(["ый", "ая", "ое", "ие"]))
        hexa = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([7, 8, 12, 16, 32, 40])))
        label = r.choice(_LABELS)
        return r.choice([
            lambda: f"{noun} {r.choice(['имени', 'им.', 'имени', 'памяти'])} {named}" + r.choice(["", ".", f", {r.randint(1, 90)} {r.choice(['цехов', 'мест', 'залов', 'лет'])}", f" № {r.randint(1, 99)}"]),
            lambda: f"{noun} {of}" + r.choice(["", f", {r.randint(1, 90)}", " закрыт", "."]),
            lambda: r.choice([f"{latin} {r.choice(['Museum', 'Prize', 'Library', 'School', 'Institute', 'Hospital', 'Foundation', 'Park', 'Theatre', 'College'])}", f"the {latin.split()[1]} {r.choice(['Institute', 'effect', 'theorem', 'method', 'Museum', 'scale'])}", f"{r.choice(['Museum', 'School', 'Library'])} named after {latin}"]),
            lambda: r.choice([f"улица {she_s}", f"на улице {of_s}", f"Проспект {he_s}", f"по {she_s[:-2]}ой улице", f"переулок {he_s}", f"{he_s} бульвар", f"ул. {she_s}", f"улица {named}", f"проспект {of_s}", f"{she_s} набережная"]) + r.choice(["", ".", " перекрыта", " открыт после ремонта.", " тянется вдоль реки", " отмечена на карте", f" длиной {r.randint(1, 9)} км", f", {r.randint(1900, 2020)} год", " и площадь", ": план"]),
            lambda: f"{label}{r.choice([' ', ' № ', ': ', ' N ', ' #', ' '])}" + r.choice([d(5), d(6), d(8), d(10), d(11), d(12), d(16), f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(3)}-{d(3)}", f"{d(3)}-{d(3)}-{d(3)} {d(2)}", f"{d(4)} {d(6)}", f"{d(2)}-{d(4)}/{d(2)}", f"{d(4)}-{d(4)}", f"{d(3)}-{d(2)}-{d(2)}", f"{d(4)} {d(4)} {d(4)}"]),
            lambda: f"{label}{r.choice([' ', ' № ', ': ', ' '])}{d(3)}-{d(2)}-{d(2)}" + r.choice(["", f", партия {d(4)}.", ".", f", {d(2)} шт."]),
            lambda: f"{r.choice(['узел', 'Узел', 'хост', 'сервер', 'host', 'порт', 'датчик', 'линия', 'цех'])} {r.choice([d(3), f'{d(3)}.0.{d(1)}.{d(3)}', self.syllables(2)])} {r.choice(['недоступен', 'failed', 'ответил', 'закрыт', 'в строю'])}, {r.choice(['код', 'code', 'ошибка', 'статус', 'номер'])} {d(3)}",
            lambda: f"{r.choice(['first_ns', 'sent_ns', 'ns', 'ts', 'epoch', 'счетчик', 'байт', 'смещение'])} {r.choice('789')}{d(r.choice([11, 12, 13, 14]))}",
            lambda: self.sentence().upper(),
            lambda: r.choice(_EVENTS) + " " + self.date() + r.choice(["", ".", " г.", " после ремонта", " и позже", ";"]),
            lambda: r.choice(["Приказ", "Договор", "Постановление", "Акт", "Письмо", "Протокол"]) + f" {r.choice(['№', 'N', '#'])} {d(r.randint(1, 4))}{r.choice(['', '-к', '/2', '-ФЗ'])} от {self.date()}",
            lambda: f"{r.choice(['версия', 'v', 'version', 'сборка', 'релиз', 'build', 'прошивка'])} {r.randint(0, 30)}.{r.randint(0, 30)}.{r.randint(0, 3000)}" + r.choice(["", f".{d(4)}", f"-rc{d(1)}"]),
            lambda: f"{d(2)}.{d(4)}{r.choice([', ', ' ', '; '])}{d(2)}.{d(4)}" if self.chance(0.5) else f"{d(2)}°{d(2)}′ с. ш. {d(2)}°{d(2)}′ в. д.",
            lambda: r.choice([f"{r.randint(1, 254)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(1, 254)}", f"узел {r.randint(1, 254)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(1, 254)}:{d(4)}", ":".join(hexa[i : i + 2] for i in range(0, 6, 2)), f"fe80::{hexa[:4]}:{hexa[3:7]}", f"MAC {hexa[:2]}:{hexa[1:3]}:{hexa[2:4]}:{hexa[3:5]}"]),
            lambda: f"{r.choice(['sha', 'хеш', 'commit', 'ревизия', 'digest', 'md5', 'uuid', 'id'])} {hexa}",
            lambda: f"{r.choice(['id', 'ts', 'time', 'first_ns', 'offset', 'seed', 'ключ', 'метка', 'pid'])}{r.choice(['=', ' ', ': ', '-'])}{d(r.choice([5, 9, 10, 11, 12, 13, 16]))}",
            lambda: f"{r.choice(['request', 'запрос', 'warmup', 'job', 'task', 'pod', 'trace'])}-{r.choice([d(5), d(8), hexa[:7], d(10)])}",
            lambda: f"{self.syllables(2, True)}@{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 20)}" if self.chance(0.6) else r.choice([f"@{self.syllables(3, True)}", f"@{self.syllables(2, True)}({r.randint(1, 9)})", f"git@host:{self.syllables(2, True)}", f"user@{self.syllables(2, True)}:~$", f"{self.syllables(2, True)}@{hexa[:8]}"]),
            lambda: f"{r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}" + r.choice(["", f".{d(3)}", f",{d(3)}", " UTC", "Z"]),
            lambda: r.choice([f"с {r.randint(1700, 1950)} по {r.randint(1950, 2024)} год", f"ГОСТ {d(5)}-{d(4)}", f"ISBN {d(3)}-{d(1)}-{d(3)}-{d(5)}-{d(1)}", f"{r.randint(1920, 2010)} года рождения", f"{r.randint(1920, 2010)} г.р.", f"{d(3)} {d(3)} рублей", f"{d(1)} {d(3)} {d(3)}", f"{d(2)} шт. по {d(3)}", f"комн. {d(3)}", f"корпус {d(1)}, этаж {d(1)}", f"{d(2)}/{d(2)}", f"1:{d(4)}", f"{d(3)}×{d(3)}", f"стр. {d(2)}-{d(3)}"]),
            lambda: r.choice([f"{he} {r.choice(['опередил соседей', 'ушел', 'молчит', 'не ответил', 'прав'])}.", f"{first} пришел", f"{first} {self.patronymic(r.choice(self.w.male), False)}", f"господин {he}", f"теорема {of}", f"метод {of}", f"закон {of}", f"Mr. {r.choice(self.w.last)}", f"{r.choice(self.w.latin)} said", f"доктор {he}", f"г-жа {she}"]),
            lambda: r.choice(_PLACES) + " " + r.choice([self.town(), adj, f"{adj} {self.town()}", f"{self.town()}-{self.town()}", he, f"{self.syllables(2).capitalize()} {self.syllables(2).capitalize()}", f"{he} {self.syllables(2).capitalize()}"]),
            lambda: f"{adj} {self.syllables(r.randint(2, 3)).capitalize()}" if self.chance(0.5) else f"{self.syllables(2).capitalize()} {r.choice(['Верно ли', 'Укажите', 'Когда', 'Сколько', 'Почему', 'Назовите', 'Где'])}",
            lambda: " ".join([self.syllables(r.randint(1, 3)).capitalize(), *(r.choice(self.w.lexicon or ("слово",)) for _ in range(r.randint(1, 3)))]),
        ])()

    def item(self, kind: str) -> tuple[str, str, str]:
        """Words before, the item, words behind."""
        if kind == "birth_date":
            return self.birth()
        if kind == "id_number":
            before, number = self.id_number()
            return before, number, ""
        if kind == "phone" and self.chance(0.2):
            before, number = self.local_phone()
            return before, number, ""
        return "", {"email": self.email, "phone": self.phone, "address": self.address, "name": self.name}[kind](), ""

    def salad(self) -> str:
        """Ordinary words in any order, hardly ever capitalized, with punctuation."""
        r = self.r
        held = r.choices(self.w.lexicon, k=r.randint(2, 9))
        if self.chance(0.1):
            held = [w.capitalize() if self.chance(0.4) else w for w in held]
        text = "".join(w + r.choice([" ", " ", " ", " ", ", ", " — ", ". ", ": "]) for w in held).strip(" ,—:")
        return text[:1].upper() + text[1:] + r.choice([".", "", "?", "!", ";"]) if self.chance(0.7) else text

    def sentence(self) -> str:
        if self.w.lexicon and self.chance(0.22):
            return self.salad()
        return self.r.choice(self.w.background if self.chance(0.7) or not self.w.common else self.w.common) if self.chance(0.88) else " ".join(self.syllables(self.r.randint(1, 4)) for _ in range(self.r.randint(2, 9))).capitalize() + self.r.choice([".", "", "?", "!"])

    def piece(self) -> list[tuple[str, int]]:
        """A sentence with one item as parts of (text, kind), 0 being none."""
        kind = self.r.choice(KINDS + ("name", "name", "address"))
        before, item, after = self.item(kind)
        if kind == "name":
            draw = self.r.random()
            item = item.lower() if draw < 0.10 else item.upper() if draw < 0.20 else item
        elif self.chance(0.08):
            before, item, after = (before.lower(), item.lower(), after.lower()) if self.chance(0.5) else (before.upper(), item.upper(), after.upper())
        if self.chance(0.55):
            a, b = self.r.choice(self.w.frames[kind]).split("{}")
        else:  # anywhere between two words
            held = self.sentence().split(" ")
            at = self.r.randint(0, len(held))
            a, b = " ".join(held[:at]) + (self.r.choice([" ", " ", ", ", ": ", " — "]) if at else ""), (self.r.choice([" ", " ", ", ", ". "]) if at < len(held) else "") + " ".join(held[at:])
        return [(a + before, 0), (item, KINDS.index(kind) + 1), (after + b, 0)]

    def example(self) -> tuple[str, list[int]]:
        """A text and the tag of each of its characters."""
        r = self.r
        parts: list[tuple[str, int]] = []
        for _ in range(r.randint(2, 4)):
            draw = r.random()
            if draw < 0.38:
                some = [(self.sentence(), 0)]
            elif draw < 0.62:
                some = [(self.alike(), 0)]
                if self.chance(0.3):
                    some = [(self.sentence() + r.choice([" ", " ", ", "]), 0), *some]
            else:
                some = self.piece()
            parts += [*some, (r.choice([" ", " ", " ", "\n", "\n\n", ". ", ", ", "; "]), 0)]
        style, text, marks = r.random(), "", []
        for value, kind in parts:
            if style < 0.07:
                value = value.lower()
            elif style < 0.13:
                value = value.upper()
            elif style < 0.19:
                value = value.replace(" ", " ")
            elif style < 0.23:
                value = value.replace(" ", "  ")
            elif style < 0.25:
                value = value.replace(" ", "\n", 1)
            elif style < 0.29 and not kind:
                value = re.sub(r"[.,:;]", "", value)
            elif style < 0.31:
                value = value.replace("-", "‑")
            elif style < 0.33:
                value = value.replace("ё", "е").replace("о", "o", 1)
            elif style < 0.36 and not kind:
                value = value.title()
            text += value
            marks += [2 * kind - (k == 0) for k in range(len(value))] if kind else [0] * len(value)
        return text, marks


_MONTHS = "января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split()
_MONTHS_EN = "January February March April May June July August September October November December".split()
_BIRTH = [
    ("родился ", ""), ("родилась ", ""), ("родился: ", ""), ("дата рождения: ", ""), ("дата рождения ", ""), ("Дата рождения — ", ""), ("д.р. ", ""), ("д. р. ", ""), ("д/р ", ""), ("ДР: ", ""), ("день рождения ", ""), ("день рождения: ", ""), ("рожден ", ""), ("рождена ", ""), ("дата рожд. ", ""),
    ("рождён ", ""), ("появился на свет ", ""), ("рожденный ", ""), ("год рождения: ", ""), ("рожд. ", ""), ("р. ", ""), ("born ", ""), ("born on ", ""), ("was born on ", ""), ("DOB: ", ""), ("DOB ", ""), ("D.O.B. ", ""), ("date of birth: ", ""), ("date of birth ", ""), ("birthday: ", ""), ("Birth date ", ""), ("b. ", ""),
    ("", " г.р."), ("", " г. р."), ("", " года рождения"), ("", " г.р"), ("", " — дата рождения"), ("", " (дата рождения)"), ("", " рождения"), ("", " гр."),
]
_INSTITUTIONS = "Завод Институт Музей Школа Больница Университет Театр Библиотека Фонд Академия Лицей Фабрика Парк Стадион Премия Площадь Обсерватория Лаборатория Училище Центр Порт Аэропорт Станция Санаторий Галерея Комбинат Колледж Клуб Шахта Мост Дворец Верфь Усадьба Госпиталь Поликлиника".split()
_LABELS = "Артикул Заказ Партия Накладная Договор Заявка Счет Счёт Трек Инвойс Order Invoice Article SKU Ticket Тикет Обращение Штрихкод Код Каталог Серийный Деталь Лот Рейс Запрос Билет Модель Инвентарный Тираж Request Tracking Case Part Ref Чек Версия".split()
_EVENTS = "Открыт Построен Основан Выпуск Обновлено Принят Запущен Собрание Срок Отчет Дата Дедлайн Изменено Released Updated Published Opened Встреча Поставка Авария Заседание Подписан Опубликовано Экспедиция Старт Сдан Проверено Издано Событие Founded".split()
_PLACES = "город село деревня посёлок река озеро остров гора станция мыс залив хребет район область долина урочище порт бухта г. пос. близ около через поселок болото".split()

_FIRSTS: set[str] = set()


def clean(text: str, words: Words, chat: bool = False) -> bool:
    """Whether a background sentence shows no sign of private data; one of a chat may not hold two capitalized words in a row."""
    if not _FIRSTS:
        _FIRSTS.update(n.lower()[:5] for n in words.male + words.female + words.latin)
    if "@" in text or "собака" in text.lower() or len(re.findall(r"\d", text)) > 8 or re.search(r"(?i)\bул\.|улиц|просп|переул|рожд|\bд\.\s?р|паспорт|снилс|инн\b|полис|\bborn\b|street|\btel|тел\b", text):
        return False
    if re.search(r"\b[А-ЯA-Z]\.\s?[А-ЯA-Z]|[(\[](?:at|dot)[)\]]", text):
        return False
    if chat and re.search(r"[А-ЯЁA-Z][а-яёa-z]+ [А-ЯЁA-Z][а-яёa-z]+", text):
        return False
    return not any(w.lower()[:5] in _FIRSTS for w in re.findall(r"[^\W\d_]{3,}", text))


def background(paths: list[str], words: Words) -> Words:
    """words with the clean sentences of at most BACKGROUND_ROWS rows of each table (a column text or messages)."""
    import pyarrow.parquet as pq

    found: list[str] = []
    for path in paths:
        names = pq.read_schema(path).names
        rows = pq.read_table(path, columns=["text" if "text" in names else "messages"]).slice(0, BACKGROUND_ROWS).to_pylist()
        chat = "text" not in names
        texts = [m and m["content"] for row in rows for m in row["messages"] or []] if chat else [row["text"] for row in rows]
        parts = [s.strip()[:160] for t in texts if t for s in re.split(r"(?<=[.?!])\s+|\n+", t) if len(s.strip()) > 3]
        good = {s for s in set(parts) if clean(s, words, chat)}
        found += [s for s in parts if s in good]
    return replace(words, background=tuple(sorted(set(found))), common=tuple(found))


def lexicon(path: str, words: Words) -> tuple[str, ...]:
    """Whole words of three letters or more in lower case from a public vocabulary (base64 of the bytes and rank on a line)."""
    import base64

    found = set()
    with open(path) as lines:
        for line in lines:
            token = base64.b64decode(line.split()[0]).decode("utf-8", "ignore")
            if re.fullmatch(r" [а-яё]{3,}| [a-z]{3,}", token) and clean(token, words):
                found.add(token[1:])
    cyrillic = sorted(w for w in found if w[0] > "z")
    return tuple(cyrillic + sorted(found - set(cyrillic))[:: max(1, len(found) // max(1, 3 * len(cyrillic)))])


def batches(maker: Maker, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Endless batches of windows of WINDOW characters, most of them around an item."""
    r = maker.r
    while True:
        codes, mask, tags = (np.zeros((WINDOW, size), dtype=t) for t in (np.int16, bool, np.int64))
        for b in range(size):
            text, marks = maker.example()
            hits = [i for i, x in enumerate(marks) if x % 2]
            at = max(0, min((r.choice(hits) if hits and r.random() < 0.8 else r.randrange(max(1, len(text)))) - r.randint(0, WINDOW * 3 // 4), max(0, len(text) - WINDOW // 2)))
            one, mark = encode(text[at : at + WINDOW]), marks[at : at + WINDOW]
            codes[: len(one), b], mask[: len(one), b], tags[: len(mark), b] = one, True, mark
        yield codes, mask, tags


def _worker(pipe, seed: int, words: Words, hidden: int, size: int) -> None:
    tagger, made = Tagger(hidden=hidden), batches(Maker(seed, words), size)
    while True:
        batch = next(made)
        tagger.p = pipe.recv()
        if tagger.p is None:
            return
        pipe.send(tagger.loss(*batch))


def fit(words: Words, hidden: int = 40, steps: int = 3000, workers: int = 8, size: int = 24, rate: float = 5e-3, start: Tagger | None = None, seconds: float = 1e9, seed: int = 101) -> Tagger:
    """Adam on the mean gradient of all workers, which make their own batches; clips gradients at norm 1.

    ``seconds`` stops early: the rate then falls by time and not by step.
    """
    import time
    from multiprocessing import get_context

    context = get_context("spawn")
    pipes = []
    for k in range(workers):
        mine, other = context.Pipe()
        context.Process(target=_worker, args=(other, seed + k, words, hidden, size), daemon=True).start()
        pipes.append(mine)
    tagger = start or Tagger(hidden=hidden)
    m, v, mean = ({k: np.zeros_like(x) for k, x in tagger.p.items()} for _ in range(3))
    began = time.time()
    for step in range(1, steps + 1):
        for pipe in pipes:
            pipe.send(tagger.p)
        got = [pipe.recv() for pipe in pipes]
        g = {k: sum(one[k] for _, one in got) / workers for k in tagger.p}
        norm = sum(float((x**2).sum()) for x in g.values()) ** 0.5
        done = max(step / steps, (time.time() - began) / seconds)
        if done >= 1:
            break
        now = rate * (0.02 + 0.98 * 0.5 * (1 + np.cos(np.pi * done)))
        for k, x in g.items():
            x = x * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            tagger.p[k] = tagger.p[k] - (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        if step % 100 == 0:
            print(step, round(sum(x for x, _ in got) / workers, 5), round(time.time() - began), flush=True)
    for pipe in pipes:
        pipe.send(None)
    return tagger


def main(args: list[str]) -> None:
    import argparse
    import os

    from karst.llm.pii import MODEL

    parser = argparse.ArgumentParser()
    parser.add_argument("texts", nargs="+")
    parser.add_argument("--steps", type=int, default=3000)
    parser.add_argument("--workers", type=int, default=8)
    parser.add_argument("--seconds", type=float, default=1e9)
    parser.add_argument("--out", default=MODEL)
    parser.add_argument("--start")
    parser.add_argument("--vocabulary")
    parser.add_argument("--rate", type=float, default=5e-3)
    parser.add_argument("--seed", type=int, default=101)
    given = parser.parse_args(args)
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
    words = background(given.texts, Words())
    words = replace(words, lexicon=lexicon(given.vocabulary, words) if given.vocabulary else ())
    print(len(words.background), "background sentences", len(words.lexicon), "words", flush=True)
    tagger = fit(words, steps=given.steps, workers=given.workers, seconds=given.seconds, rate=given.rate, start=Tagger.load(given.start) if given.start else None, seed=given.seed)
    tagger.save(given.out)


if __name__ == "__main__":
    import sys

    main(sys.argv[1:])
