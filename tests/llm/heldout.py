"""Names, streets and sentences that the trainer of the tagger never sees."""

import random

from karst.llm import pii_train

FRAMES = {
    "email": ("Если что-то пойдет не так, сразу дайте знать на {}, мы дежурим круглосуточно.", "Приглашение ушло в {} еще в пятницу.", "Дубль квитанции просили прислать сюда: {} (не позднее среды).", "Please forward the receipt to {} before noon.", "Подписка оформлена на {}; отменить ее нельзя.", "У меня не открывается ящик {} с понедельника"),
    "phone": ("Курьер не дозвонился до {} и оставил коробку у соседей.", "Если задержусь, стучите на {}.", "Запишите: {} — это бабушкин.", "You can text {} any time.", "В анкете стоит {}, но никто не берет трубку.", "Сим-карта {} заблокирована с мая."),
    "address": ("Шкаф нужно поднять на третий этаж, {}.", "Последние пять лет семья снимает жилье: {}.", "Курьеру сказали ехать сюда: {}, домофон не работает.", "The parcel was left at {} by mistake.", "Собака потерялась возле {}, помогите найти.", "В договоре аренды указано {}, проверьте"),
    "name": ("Документы вчера принесла {}.", "На собрании выступит {} с докладом о насосах.", "Квартиру снимает {}, договор до весны.", "Никто не знает, куда уехал {} после смены", "The keys were handed to {} on Monday.", "Оплата поступила от {} без назначения.", "Второй пассажир — {}.", "We interviewed {} about the outage."),
    "birth_date": ("Свидетель {} подтвердил сказанное.", "В карте ребенка значится: {}, прививки сделаны.", "Страхователь ({}) живет отдельно.", "The applicant, {}, has no children.", "Участник {} допущен к старту."),
    "id_number": ("Банк запросил {} повторно.", "На обороте справки напечатано {} и стоит штамп.", "Нотариус сверил {} и поставил подпись.", "The clerk typed {} into the form.", "Без {} заселить не сможем."),
}
BACKGROUND = ("Насос на второй станции снова шумит, бригада выезжает утром.", "Отчет за квартал сдан, замечаний нет.", "The scheduler retried the batch after a short pause.", "Почему вода в колодце стала мутной?", "Поезд опоздал на сорок минут, и лекцию перенесли в большой зал.", "Склад закрыт на учет до конца недели.", "Ни один из трех образцов не выдержал нагрева.", "Memory pressure stayed low during the whole run.")


def words() -> pii_train.Words:
    return pii_train.Words(
        male=tuple("Вениамин Филипп Афанасий Ефим Мирон Остап Тихон Яков Герман Всеволод Эмиль Артур".split()),
        female=tuple("Клавдия Антонина Агата Ярослава Пелагея Фаина Эльза Стелла Аделина Юлиана Лариса Мирослава".split()),
        latin=tuple("Gregory Stephanie Walter Rachel Oscar Beatrice Philip Helen Victor Laura Simon Judith".split()),
        stems=tuple("Черныш Гаврил Ефим Тимоф Давыд Логин Рыбак Сухан Трофим Фаде Харитон Чистяк Широк Юдин Яким Глад Печен Снегир".split()),
        last=tuple("Bennett Hughes Foster Butler Simmons Larsson Schneider Bianchi Lefebvre Petersen Doyle Hartmann".split()),
        streets=tuple("Цветоч Яс Ручей Боров Малинов Колхоз Весен Радуж Грибоед Ольхов Проточ Окруж".split()),
        owners=tuple("Чайковского Некрасова Тургенева Королёва Менделеева Вавилова Репина".split()),
        frames=FRAMES,
        background=BACKGROUND,
    )


def texts(seed: int, n: int) -> list[tuple[str, str, str]]:
    """(text, kind, item): one item in a sentence of its own among others; kinds stand in turn."""
    made, r, out = pii_train.Maker(seed, words()), random.Random(seed), []
    for k in range(n):
        kind = pii_train.KINDS[k % len(pii_train.KINDS)]
        before, item, after = made.item(kind)
        sentence = r.choice(FRAMES[kind]).replace("{}", before + item + after)
        out.append((" ".join(r.sample([r.choice(BACKGROUND), sentence, r.choice(BACKGROUND)], 3)), kind, item))
    return out


def alikes(seed: int, n: int) -> list[str]:
    made, r = pii_train.Maker(seed, words()), random.Random(seed)
    return [f"{r.choice(BACKGROUND)} {made.alike()}. {r.choice(BACKGROUND)}" for _ in range(n)]
