"""The event vocabulary. Keywords are compared as whole lemmas; those of several words can't equal one token."""

from __future__ import annotations

# Fixed values. Two of the list's entries are one word by a missing comma in the source; CORRECTED parts them.
KEYWORDS = [
    "Конференц", "Конфа", "Conf", "Conference", "Митап", "Мит", "Meetup", "Meet", "Мастер-класс", "Воркшоп", "Workshop", "Мастеркласс",
    "Вебинар", "Веб", "Webinar", "Семинар", "Seminar", "Лекци", "Lecture", "Public talk", "Техтолк", "Tech talk", "Форум", "Forum",
    "Саммит", "Summit", "Simposium", "Хакатон", "Hackathon", "Дататон", "Datathon", "Идеатон", "Ideathon", "Интенсив", "Intensive",
    "Буткемп", "Bootcamp", "Круглый стол", "Roundtable", "Панельная дискуссия", "Panel discussion", "Networking", "Нетворк",
    "Обсуждение", "Дебат", "Встреча", "Контест", "Афиша", "Дайджест", "Digest", "Календарь", "Lineup", "Стажиров",
    "Демо-день", "Demo day", "Демка", "ДемоАкселератор", "Accelerator", "Акселер", "Инкубатор", "Incubator", "Питч", "Pitching",
    "Pitch deck", "Стартап", "Startup", "Launch", "Релиз", "Release",
    "Регистрация", "Register", "Registration", "Signup", "Sign up", "RSVP", "Зарегистрироваться", "Зарегаться", "Запись", "Записаться",
    "Участие", "Участвовать", "Attend", "Attendee", "Присоединиться", "Join", "Приглашение", "Invitation", "Приглашаем", "Ждем вас",
    "Билет", "Ticket", "Early bird", "Sold out", "Бесплатно", "Вход свободный", "Спикер", "Speaker", "Докладчик", "Keynote",
    "Выступление", "Talk", "CFP", "Call for papers", "Call for speakers", "Прием заявок", "Подать заявку",
    "Программа", "Program", "Agenda", "Расписание", "Schedule", "Повестка", "Место", "Venue", "Локация", "Площадка", "Адрес", "Address",
    "Онлайн", "Online", "Трансляция", "Broadcast", "Стрим", "Stream", "Live", "Эфир", "Офлайн", "Offline", "Оффлайн", "Гибрид", "Hybrid",
    "Дата", "Date", "Начало", "Starts at", "Сбор", "Афтерпати", "Afterparty", "Препати", "Preparty", "Вечеринка", "Party", "Вечер",
    "Конкурс", "Contest", "Challenge", "Челендж", "Турнир", "Tournament", "Чемпионат", "Championship", "Награжден", "Ceremony", "Gala",
    "Квиз", "Quiz", "Розыгрыш", "Приз", "Awards", "Сообщество", "Community", "Слет", "Camp", "Camping", "AMA session", "AMA-сессия",
    "Вопросы и ответы", "Q&A", "Open day", "День открытых дверей", "Встреча", "Сходк",
]

CORRECTED = [k for w in KEYWORDS for k in (("Демо", "Акселератор") if w == "ДемоАкселератор" else (w,))]


def lemma_set(keywords: list[str], lemma: dict[str, str] | None = None) -> list[str]:
    """Keywords lower-cased and, where a dictionary knows them, as lemmas; each once."""
    lower = [k.strip().lower() for k in keywords]
    return list(dict.fromkeys((lemma or {}).get(k, k) for k in lower))
