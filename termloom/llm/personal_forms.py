"""Forms, contexts and shapes of personal items: what a place looks like before any pattern of the corpus is known.

Nothing here decides alone. Every candidate place gets a prior from what it looks like and what kinds of words
stand around it; the graph of the corpus's own patterns (``personal``) confirms or overrules it.
"""

from __future__ import annotations

import math
import re

# Given names that serve as seeds, common in several countries.
SEED_NAMES = set(
    """ahmed ali alice amina ana andrea andrew anna anne antonio carlos carmen catherine charles christopher claire
    daniel david elena elizabeth emily emma erik eva fatima francesca giulia giovanni hannah hans helen ivan james jan
    javier jean john jose juan julia karen karl kenji laura li lucia luis maria mario mark marta martin mary
    michael miguel mohammed nicole olga omar paul pedro peter pierre richard robert rosa samuel sara sarah sofia
    stephen susan thomas victoria wei william yuki""".split()
)
# Titles and labels that stand before a name and are none.
TITLES = set(
    """mr mrs ms miss mx dr prof sir madam nurse doctor professor patient herr frau sr sra srta dra don doña señor
    señora m mme mlle monsieur madame dott signora signor pani pan sister brother father rabbi imam pastor sergeant
    captain fru hr mevrouw meneer dhr mw sig доктор г-н г-жа""".split()
)
# What diseases, signs, scores and the like that bear a name are called.
EPONYM_HEADS = set(
    """disease syndrome sign score phenomenon anomaly lymphoma tremor palsy gout ulcer disorder scale index
    criteria classification fracture procedure manoeuvre maneuver reflex triad tumor tumour sarcoma carcinoma
    thyroiditis chorea ataxia dystrophy contracture hernia cyst node law body bodies esophagus stain grade
    street road avenue ave court blvd diseases signs scores krankheit syndrom zeichen maladie enfermedad síndrome
    virus fever vaccine malformation deformity nodes cells effect murmur catheter solution""".split()
)
# Heads that may follow a disease's name or a patient's alike.
LOOSE_HEADS = set("test unit lane clinic ward hospital stage position line point method technique operation tests".split())
# What makes the words before it an organisation or a place.
PLACE_HEADS = set(
    """hospital clinic center centre university college school institute foundation pharmacy inc ltd llc gmbh bank
    insurance county river park bridge valley island islands airport station church museum library hotel street
    road avenue lane health healthcare medical laboratories labs pharmaceuticals infirmary trust council city beach bay
    mountains ocean sea""".split()
)
# Words before which no name but a place's stands.
PLACE_LEFT = set("lake mount mt port fort cape isle gulf near north south east west northern southern eastern western".split())
# Particles inside names.
PARTICLES = set("van der den de del della di da dos la le von zu zur ní nic mac bin ibn al el ter ten af av y e".split())
# Words that are never names, wherever they stand.
NEVER = set(
    """a am an and are as at be but by can could do for from had has have he her here hi hello his how i if in is it
    its me my no not of on or our she should so than that the their them they this to was we were what when where
    which who why with would you your good morning regards thanks thank please dear signed sincerely yes el la
    los las un una mi de der die das den ein eine le les une et und y adresse address tel phone call email mail
    online again writing monday tuesday wednesday thursday friday saturday sunday january february march
    july september october november december i'm i've i'd i'll it's don't can't let's he's she's that's
    there these those some any all every each after before since until while during because also just only very
    still now then today tomorrow yesterday tonight evening afternoon night yours best kind warm cheers love
    sincerely faithfully sent attn cc re fw subject ps note yet both either neither once however although though
    did does may't will't shall must might about over under into onto off out up down again against between through
    ich nicht ist mein meine je mon ma me moi est il elle nous vous sie er wir ihr bitte guten tag mit für von hola
    gracias por para con como mon votre merci bonjour ciao grazie sono il lo gli che non per
    меня я мой моя вы мы он она и в на не что это как по за из от к у с tak jest się nie mam jestem proszę
    signature name names username patient patients doctor nurse mother father brother sister""".split()
)
# Names that are ordinary words as well; alone at the start of a sentence they say little.
AMBIGUOUS = set("may will mark april june august rose grace hope faith joy iris dawn bill rob pat sue art gene frank grant chase hunter cliff dean guy jack drew wade miles victoria".split())
# Seeds of what is capitalised and no person: places, peoples, makers, makes, bodies and the like.
OTHERS = set(
    """london paris berlin madrid rome vienna lisbon dublin edinburgh glasgow manchester birmingham leeds bristol
    boston chicago houston dallas seattle denver atlanta miami phoenix philadelphia detroit toronto montreal vancouver
    sydney melbourne tokyo osaka kyoto beijing shanghai delhi mumbai bangalore karachi lagos nairobi cairo istanbul
    moscow kyiv warsaw prague budapest athens amsterdam rotterdam brussels zurich geneva munich hamburg frankfurt
    stockholm oslo copenhagen helsinki mexico brazil argentina chile colombia peru spain france germany italy
    portugal ireland scotland wales england britain kingdom america canada australia zealand japan china india
    pakistan nigeria kenya egypt turkey russia ukraine poland greece netherlands belgium switzerland austria sweden
    norway denmark finland europe asia africa texas california florida ohio oregon arizona nevada colorado virginia
    michigan illinois pennsylvania massachusetts york jersey hampshire english spanish french german italian
    portuguese russian chinese japanese korean arabic hindi polish turkish dutch greek swedish american british
    african european asian latino hispanic muslim christian jewish catholic christmas easter ramadan tylenol
    advil aspirin ibuprofen lipitor ozempic humira zoloft prozac xanax viagra botox ventolin synthroid nexium
    google apple amazon facebook zoom whatsapp medicare medicaid internet covid moderna pfizer astrazeneca
    parkinson parkinson's alzheimer alzheimer's crohn's hodgkin hodgkin's huntington's down's tourette raynaud
    monday's god bible english kaiser mayo walgreens walmart costco nhs fda cdc hiv aids mri ct ecg ekg
    portal message medication insulin metformin vitamin""".split()
)
_DRUG = re.compile(r".{3,}(?:statin|mab|pril|olol|azole|cillin|mycin|sartan|itis|osis|emia|aemia|pathy|vir|tinib|gliptin|flozin|triptan|zepam|profen|caine|setron|parin|oxacin|cycline|tide|ectomy|scopy|gram|oma)s?")
# What introduces a name. Two words where one is not enough.
NAMING = set(
    """named llama llamo heiße heisse heißt heet appelle m'appelle s'appelle chiamo chiama nazywam chamo зовут звать
    surname fullname""".split()
)
NAMING_2 = set(
    """name_is name's_is name_: im_called i_am am_called is_called it_is name_# nombre_es nom_est nome_è nome_é
    name_ist navn_er naam_is mi_chiamo signed_by written_by speak_to speak_with spoke_to spoke_with talk_to
    talked_to talked_with seen_by saw_by referred_by under_dr care_of attention_of behalf_of copy_to this_is
    it's_me prescribed_by done_by operated_by from_dr to_dr guardian_is sent_by written_for booked_for asked_for
    appointment_for records_for results_for form_for chart_for chart_of record_of file_of daughter_of son_of""".split()
)
KIN = set(
    """wife husband son daughter mother father mom mum dad brother sister caregiver carer guardian partner friend
    neighbour neighbor roommate colleague aunt uncle cousin nephew niece grandmother grandfather grandma grandpa
    granddaughter grandson stepson stepdaughter fiancé fiancée spouse child baby twin hermano hermana hijo hija esposa
    esposo marido madre padre sohn tochter mutter vater bruder schwester mann mari femme fils fille frère sœur
    moglie marito figlio figlia nurse doctor physician surgeon therapist physiotherapist midwife pharmacist
    receptionist dentist cardiologist dermatologist pediatrician paediatrician psychiatrist psychologist consultant
    specialist gp dietitian counsellor counselor interpreter chaplain patient pt client resident owner employee
    applicant claimant beneficiary manager supervisor boss teacher landlord lawyer representative agent contact
    secretary optician radiologist oncologist neurologist urologist anaesthetist anesthesiologist paramedic""".split()
)
ASKING = set(
    """tell told ask asked contact inform notify thank thanks meet met saw see remind call called phone email
    text visit visited let help helped drove brought introduced ringing calling phoned emailed messaged""".split()
)
GREETING = set("hi hello dear hey attn cc hola hallo bonjour ciao estimada estimado liebe lieber geehrte geehrter cher chère cara caro regards sincerely yours truly faithfully cheers love signed atentamente saludos grüße grüßen gruß cordialement saluti thanks best wishes gratefully respectfully".split())
JOINING = set("with by for and or than like mit von für con para por avec pour".split())
SAYING = set(
    """told said says called writing speaking asked prescribed wants who phoned emailed recommended dob born md rn phd
    jr mentioned explained suggested ordered referred saw examined operated gave works lives needs will would
    cannot can't has is was had here wrote signed thinks thought reported noticed booked cancelled canceled texted
    came come went drove moved takes took feels felt join attend""".split()
)
_HIRAGANA = "぀-ゟ"
_HAN = "㐀-鿿"
_KANA = "゠-ヿ"
#: Names in scripts without blanks stand between an opening and a closing form of address.
UNSPACED_NAME = re.compile(
    rf"(?:我叫|我是|姓名[:：]?\s?|名字是|叫做|名前は|氏名[:：]?\s?|私は)([{_HAN}]{{2,4}}?)(?=(?:です|と申|だ|、|,|，|。|\.|\s|的|，|$|[^{_HAN}]))"
    rf"|(?<![{_HAN}{_KANA}])([{_HAN}]{{1,4}}?|[{_KANA}]{{2,8}})(?=(?:先生|女士|小姐|太太|医生|護士|护士|さん|様|氏|さま))"
    r"|(?:이름은|성함은)\s?([가-힣]{2,4}?)(?=(?:입니다|이에요|예요|이고|\s|\.|,|$))|(?<![가-힣])([가-힣]{2,4})(?=\s?(?:씨|님))"
)

_AT = r"(?:\s?@\s?|\s?[\[({<]\s?at\s?[\])}>]\s?)"
_DOT = r"(?:\.|\s?[\[({<]\s?dot\s?[\])}>]\s?|\s+dot\s+)"
_LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
EMAIL = re.compile(
    rf"(?<![\w.+%-])[\w.+%'-]*[^\W_]{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[^\W\d_]{{2,}}(?![\w@])"
    rf"|(?<![\w.+%-])[\w.+%'-]*[^\W_]\s+at\s+{_LABEL}(?:\s+dot\s+{_LABEL})*\s+dot\s+[^\W\d_]{{2,}}(?!\w)",
    re.I,
)
_PLAIN_EMAIL = re.compile(r"[\w.+%'-]*[^\W_]@" + _LABEL + r"(?:\." + _LABEL + r")*\.[^\W\d_]{2,}")
_CITY = r"(?:(?:north|south|east|west|new|old|upper|lower|saint|st\.?|port|great|little|bad|san|santa|los|las)\s+)?[^\W\d_][\w'’-]+(?:\s+(?:falls|springs|city|heights|hill|hills|beach|park)\b)?"
_ZIP = r"(?:[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}\b)"
_TAIL = rf"(?:,\s*(?:unit|apt|apartment|flat|suite|no|floor)\b\.?\s*[\w-]+)?(?:,\s*(?:\d{{4,5}}\s+)?{_CITY}(?:\s+{_ZIP})?)?(?:,\s*[A-Z]{{2}}\s+\d{{4,5}}(?:-\d{{4}})?|\s+\d{{5}}(?!\d)|,\s*{_ZIP})?"
_NAMED = r"(?!(?:blocks?|miles?|days?|weeks?|hours?|minutes?|times?|years?|mg|ml|down|the|in|of|on|and|a|was|is|cm|km|patients?|from|to|up)\b)(?:[^\W\d_][\w'’.-]*|\d{1,3}(?:st|nd|rd|th)\b)"
ADDRESS = re.compile(
    rf"\b(?:p\.?\s*o\.?\s*box|post\s*box|postfach|apartado(?:\s+de\s+correos)?|boîte\s+postale|casella\s+postale)\s+\d+{_TAIL}"
    rf"|(?:\b(?:apt|apartment|unit|flat|suite)\.?\s*[\w-]+,\s*)?(?<![\w.,-])\d{{1,5}}[a-z]?\s+(?:[nsew]\.?\s+)?(?:{_NAMED}\s+){{1,4}}?"
    rf"(?:street|st|road|rd|avenue|ave|boulevard|blvd|lane|ln|court|ct|drive|way|place|square|sq|terrace|crescent|close|parkway|highway|row)\b\.?{_TAIL}"
    rf"|(?<![\w.,-])\d{{1,4}}(?:\s?(?:bis|ter))?,?\s+(?:rue|avenue|boulevard|place|chemin|impasse|allée|quai|route|cours)\s+(?:(?:de|des|du|la|le|les)\s+|d'|l')*[^\W\d_][\w'’-]*(?:,\s*\d{{4,5}}\s+{_CITY}|,\s*{_CITY})?"
    rf"|\b(?:calle|c/|avenida|avda\.?|plaza|paseo|camino|carrera|via|viale|piazza|corso|rua|travessa)\s+(?:[^\W\d_][\w'’-]*\s+){{1,4}}\d{{1,4}}(?:,\s*\d{{1,2}}\s?[ºª°o]?\s*[a-z]?\b)?(?:,\s*{_CITY})?"
    rf"|\b[^\W\d_][\w-]{{2,}}(?:straße|strasse|str\.|weg|allee|platz|gasse|ring|damm|ufer|straat|laan|gatan|vägen)\s+\d{{1,4}}[a-z]?\b(?:,\s*\d{{4,5}}\s+{_CITY})?",
    re.I,
)
#: Looser forms, which need a context that speaks for them.
LOOSE_ADDRESS = re.compile(
    rf"(?<![\w.,-])\d{{1,5}}[a-zA-Z]?\s+(?:[A-Z][\w'’-]*\s+){{1,3}}(?i:gardens|mews|grove|hill|park|rise|walk|gate|green|quay|trail|loop|circle|cir|plaza|alley|path|vale|view|wharf|yard|bridge|meadows?|fields|heights|parade|promenade|villas|cottages|broadway|embankment|esplanade|ridge|run|pike|turnpike)\b{_TAIL}"
    rf"|(?<![\w.,-])\d{{1,5}}[a-zA-Z]?\s+(?!(?i:days?|weeks?|months?|years?|hours?|minutes?|mg|ml|mcg|miles?|blocks?|times?|tablets?|pills?|units?|cm|km)\b)(?:[A-Z][\w'’-]+\s+)*[A-Z][\w'’-]+,\s*{_CITY}(?:,?\s+{_ZIP}|,?\s+[A-Z]{{2}}\s+\d{{5}})?"
    rf"|\b(?i:calle|avenida|avda\.?|plaza|paseo|rua|travessa|via|viale|piazza|corso)\s+(?:[^\W\d_][\w'’-]*\s+){{0,4}}[^\W\d_][\w'’-]*,\s*(?:n[º°o.]*\s*)?\d{{1,4}}(?:,\s*{_CITY})?"
    r"|\b(?:(?:Am|Im|An der|An den|Auf dem|Auf der|In der|Zum|Zur|Unter den)\s+[A-ZÄÖÜ]\w+|[A-ZÄÖÜ]\w+er\s+(?:Straße|Str\.|Weg|Platz|Allee|Damm|Ring))\s+\d{1,4}[a-z]?\b(?:,\s*\d{5}\s+[A-ZÄÖÜ][\w-]+)?"
    r"|\b(?:ul\.|ulica|os\.|al\.)\s+[^\W\d_][\w-]*(?:\s+[^\W\d_][\w-]*)?\s+\d{1,4}\w?(?:/\d+)?(?:,\s*(?:\d\d-\d{3}\s+)?[^\W\d_][\w-]+)?"
    r"|(?:\bг\.\s*[^\W\d_]+,\s*)?\b(?:ул\.|улица|пр\.|проспект|пер\.)\s*[^\W\d_][\w-]*(?:\s+[^\W\d_][\w-]*)?,?\s*(?:д\.|дом)?\s*\d{1,4}(?:,\s*кв\.\s*\d+)?"
    r"|(?:〒\s?\d{3}-\d{4}\s*)?[㐀-鿿]{2,3}[都道府県][㐀-鿿぀-ヿ0-9]{1,20}?[0-9一二三四五六七八九十]+(?:丁目|番地?|号|[-－−‐–]\d+)(?:[0-9一二三四五六七八九十\-－]*(?:番地?|号|\d))*"
    r"|[㐀-鿿]{2,8}(?:省|市|区|县)[㐀-鿿]{1,12}(?:路|街|道|巷|弄)\s?\d{1,5}\s?号(?:\s?\d+\s?[栋室楼])*"
    r"|[가-힣]{2,6}(?:시|도)\s?[가-힣]{1,6}(?:구|군|시)\s?[가-힣0-9]{1,12}(?:로|길|동)\s?\d{1,4}(?:-\d+)?(?:번지)?"
)
NUMBER = re.compile(r"(?<![\w.@/-])(?:[A-Za-z]{1,3}-?)?(?:\+|00)?\(?\d(?:\d|(?:[ .\-/]{1,2}|\)[ -]{0,2}|[ -]{0,2}\()(?=[\d(]))*[A-Za-z]?(?![\w@])(?:\s{0,2}(?:ext\.?|x)\s{0,2}\d{1,5}\b)?")
#: Letters and digits mixed, as in fiscal codes.
MIXED = re.compile(r"(?<![\w.@/-])(?=[A-Z0-9]*[A-Z])(?=(?:[A-Z]*\d){5})[A-Z0-9]{8,20}(?![\w@-])|(?<![\w.@/-])[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D](?![\w@-])|(?<![\w.@/-])(?=[0-9-]*[A-Z])(?=(?:[A-Z-]*\d){4})[A-Z0-9]{2,5}(?:-[A-Z0-9]{2,5}){1,4}(?![\w@-])")
DATE = re.compile(r"(?:19|20)\d\d[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.](?:19|20)\d\d")

# Words near which a number is a telephone number, and near which it is one issued to a person.
PHONE_CUES = set(
    """phone telephone tel mobile cell cellphone cellular call calling text dial ring reach fax landline whatsapp sms
    pager voicemail callback handy telefon telefonnummer mobil rufnummer anrufen teléfono telefono móvil celular
    llamar llámame téléphone portable appeler joindre cellulare telefone telemóvel ligar telefoon bellen телефон
    тел номер telefonu numer contact ph mob hotline extension 电话 手机 電話 携帯 전화""".split()
)
ID_CUES = set(
    """ssn mrn nhs passport insurance insured member membership policy subscriber medicare medicaid license licence
    licencia identity identification social beneficiary enrollee versichertennummer krankenversicherung
    sozialversicherungsnummer steuer-id personalausweis reisepass dni nie nif nuss pasaporte cédula cedula curp rfc
    cpf nino nin fiscale fiscal sécu bsn personnummer pesel snils инн снилс паспорт aadhaar pan mykad national
    patient hospital chart record ni id hic mbi ahv emirates kimlik 身份证 护照 マイナンバー 주민등록번호 tax taxpayer nric""".split()
)
# Those of them that say so only with a word for number behind them.
LOOSE_ID_CUES = {"patient", "hospital", "chart", "record", "national", "social", "tax"}
# Words between a cue and its number that put no distance between them.
FILLERS = set("is no number num nr my the of card es ist est è # code ref was as".split())
OTHER_CUES = set(
    """lot batch order pmid ndc loinc nct isbn issn doi article trial serial model invoice tracking reference version
    icd cpt hcpcs bp ratio range score level dose mg ml mcg room bed lane ticket item sku part build study gene
    chromosome snomed rxnorm page issue vol volume product device code codes barcode parcel shipment coordinates
    population budget dollars euros usd eur paid cost costs total temperature year years catalog catalogue charge""".split()
)
PHONE_SHAPE = re.compile(
    r"(?:\+|00)\d{1,3}(?: ?\d){6,13}|\(3\) ?3[- .]?4|\(3\)7|3[- .]3[- .]4|1[- .]3[- .]3[- .]4|3-4|10|11|2 2 2 2 2|(?:[345] [34] [34])|5 6|5 3 3|4 7|2 4 4|3 4 4|3-4-4|2-4-4|4 3 3|3 3 3|3 2 2 2|4 6|5-6|4-7|2 8|3-7|3 7|4 4|2 3 4|2 3 3|3 8|3-8|4[- ]5|3 3 2 2|1 2 2 2 2|5[- ]5|2 [34] [34]|4 2 2 2|5 [567]|\(\d\) ?\d[ -]\d"
)


def digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def shape(number: str) -> str:
    number = re.sub(r"\s*(?:ext\.?|x)\s*\d+$", "", re.sub(r"\s+", " ", number.strip()), flags=re.I)
    return re.sub(r"[A-Za-z]", "A", re.sub(r"\d+", lambda m: str(len(m[0])), number))


def seed_kind(number: str) -> str:
    """The kind of a number whose format alone gives it away, or ''."""
    s = shape(number)
    if number.startswith("+") and 8 <= digits(number) <= 15 or re.fullmatch(r"\(3\) ?3[- .]4|1-3-3-4|2 2 2 2 2", s):
        return "phone"
    return "id_number" if s in ("3-2-4", "8A", "A9") else ""


def _checked(number: str) -> bool:
    """Whether a number's own check digits or form mark it as one issued to persons."""
    s = re.sub(r"[ -]", "", number).upper()
    if re.fullmatch(r"[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\d{6}[A-D]", s) or re.fullmatch(r"[A-Z]{6}\d\d[A-EHLMPRST]\d\d[A-Z]\d{3}[A-Z]", s):
        return True
    if re.fullmatch(r"\d{8}[A-Z]", s):
        return "TRWAGMYFPDXBNJZSQVHLCKE"[int(s[:8]) % 23] == s[8]
    if re.fullmatch(r"\d{3} \d{3} \d{4}", number):
        t = [int(c) for c in s]
        return (11 - sum(d * w for d, w in zip(t, range(10, 1, -1), strict=False)) % 11) % 11 == t[9]
    if re.fullmatch(r"\d{3}\.\d{3}\.\d{3}-\d\d", number):
        return True
    return False


def logistic(x: float) -> float:
    return round(1 / (1 + math.exp(-x)), 2)


def number_priors(number: str, left: list[str], right: list[str]) -> tuple[float, float]:
    """(phone, identity number): how likely a number is each by its form and the words around it (nearest first)."""
    n, s = digits(number), shape(number)
    head = re.match(r"[A-Za-z]+", number)
    phone = 3.0 if seed_kind(number) == "phone" else -0.6 if PHONE_SHAPE.fullmatch(s) and 7 <= n else -2.5
    ident = (2.2 if any(map(str.isalpha, number)) else 1.2) - 2.5 * (not any(map(str.isalpha, number))) if _checked(number) else 1.5 if seed_kind(number) == "id_number" else -2.5
    if not 6 <= n <= 15:
        phone -= 4
    if head:
        phone -= 5
    if number.lstrip("(").startswith(("0", "+")) and 9 <= n <= 15:
        phone += 0.8
    for words, weight in ((left, 1.0), (right[:3], 0.6)):
        place = -1
        for w in words:
            place += w not in FILLERS
            if place > 3:
                break
            near = weight * (1.0 if place < 2 else 0.75)
            if w in ("<b>", "<n>", "<item>"):
                break
            if w in OTHER_CUES:
                phone -= 3.5 * near
                ident -= 2.5 * near
            if w in PHONE_CUES:
                phone += 3.2 * near
                ident -= 1.2 * near
                break
            if w in ID_CUES:
                near *= 0.3 if w in LOOSE_ID_CUES and w == words[0] else 1.0
                ident += 4.0 * near
                phone -= 3.5 * near
                break
    return logistic(phone), logistic(ident)


# Words near which somebody's address stands.
HOME_CUES = set(
    """live lives living address moved move home house residence residing reside mail send sent ship deliver adresse
    anschrift wohne wohnt wohnen vivo vive vivimos dirección domicilio domicilié j'habite habite habitons abito
    indirizzo moro morada endereço mieszkam adres woon adresa живу адрес 住所 地址 住在 주소 stay staying visit at""".split()
)


def address_prior(text: str, strict: bool, left: list[str]) -> float:
    p = 4.0 if strict else -1.4
    if not strict:
        p += 1.2 if re.search(rf",\s*(?:\d{{4,5}}\s+)?[^\W\d_]|{_ZIP}", text) else 0.0
        p += 2.0 if re.match(r"\d{1,5}\w?\s+(?:\S+\s+){1,3}(?:gardens|mews|grove|hill|rise|walk|quay|trail|circle|vale|wharf|view|green)\b", text, re.I) else 0.0
        p += 2.6 if not text[0].isdigit() else 0.0
        p += 2.2 if any(w in HOME_CUES for w in left[:4]) else 0.0
    return logistic(p)


def email_prior(text: str) -> float:
    return 0.98 if _PLAIN_EMAIL.fullmatch(text) else 0.9 if re.search(r"@|\bat\b.*\bdot\b|[\[({<]\s?at", text, re.I) else 0.6


def name_prior(word: str, run: list[str], at: int, left: list[str], right: list[str], start: bool, cased: bool, nouns: bool, owner: str) -> float:
    """How likely ``word``, the ``at``-th of a run of words written alike, names a person. ``left`` and ``right`` are
    the words around the run, nearest first; ``start`` says that the run opens a sentence, ``cased`` that the text
    uses capitals, ``nouns`` that its language gives them to all nouns, ``owner`` is the head behind a possessive."""
    low = word.casefold()
    l1, l2 = (left + ["<b>", "<b>"])[:2]
    r1 = right[0] if right else "<b>"
    r2 = right[1] if len(right) > 1 else "<b>"
    many = len(run) > 1
    small = word[0].islower() or not cased
    if small:
        x = -2.6
    elif word.isupper() and len(word) > 1:
        x = -1.6 if len(word) > 3 or many else -2.8
    elif start:
        x = -0.6 if many else -2.4
    else:
        x = 0.7 if many else -0.9
    if nouns and not small:
        x -= 1.8
    if l1 in TITLES or l1 in NAMING:
        x += 5.0 if not small or l1 in NAMING or len(l1) < 5 else 1.2
    elif f"{l2}_{l1}" in NAMING_2:
        sure = l2.startswith(("name", "nombre", "nom", "navn", "naam", "mi"))
        x += 4.5 if sure else 3.0 if not small else 0.3
    elif l1 in KIN or l1 in ("is", "was", "ist", "es", "est", "è", "é", "er") and l2 in KIN:
        x += 3.6 if not small else 0.8
    elif l1 in GREETING or l1 == "<b>" and l2 in GREETING:
        x += 3.4 if not small else 0.8
    elif l1 in ASKING:
        x += 2.4 if not small else 1.0
    elif l1 in ("name", "names", "nombre", "nom", "nome", "imię", "nazwisko"):
        x += 3.6
    elif l1 in JOINING:
        x += 0.9
    elif l1 in PLACE_LEFT or any(w.casefold() in PLACE_LEFT for w in run[: at + 1]):
        x -= 4.5
    elif l1 in ("in", "at", "near", "into", "across", "around"):
        x -= 2.2
    elif l1 in ("the", "a", "an", "this", "my", "our", "your", "no", "take", "taking", "on", "of", "der", "die", "das", "le", "la", "el", "these"):
        x -= 0.6 if l1 == "of" else 4.0 if many and l1 == "the" else 2.4
    elif l1 == "<n>":
        x -= 1.2
    first = run[at - 1].casefold() if at else ""
    if low in SEED_NAMES:
        x += (1.2 if start and not many else 3.0) if low not in AMBIGUOUS else 1.0 if not start else -0.6
        x += 0.6 if at + 1 < len(run) and run[at + 1].casefold() not in OTHERS else 0.0
    elif first in SEED_NAMES:
        x += 3.2
    elif at + 1 < len(run) and len(run) == 2 and run[at + 1].casefold() in SEED_NAMES:
        x += 0.6
    if r1 in EPONYM_HEADS or owner in EPONYM_HEADS:
        x -= 7.0 if owner or at + 1 == len(run) else 3.5 if at + 2 == len(run) else 1.0
    elif r1 in PLACE_HEADS or any(w.casefold() in PLACE_HEADS for w in run[at + 1 :]):
        x -= 4.5 if r1 not in LOOSE_HEADS or l1 not in TITLES else 0.0
    elif r1 in LOOSE_HEADS or owner in LOOSE_HEADS:
        x -= 0.8 if not small else 0.5
    elif r1 == "<n>":
        x -= 1.6
    elif r1 in SAYING and not small:
        x += 2.6 if r1 not in ("is", "was", "has", "had", "will", "would", "here", "came", "went", "works", "lives", "needs", "takes") else 0.7
    elif r1.endswith("ed") and len(r1) > 4 and not small:
        x += 1.8
    if r1 in ("is", "who") and r2 in ("my", "the", "our", "his", "her"):
        x += 1.6
    if r1 in KIN and not small:
        x += 0.4
    if owner and owner not in EPONYM_HEADS:
        x += 1.6
    if low in OTHERS or any(w.casefold() in OTHERS for w in run):
        x -= 4.5
    elif _DRUG.fullmatch(low):
        x -= 3.5
    elif low in AMBIGUOUS and low not in SEED_NAMES:
        x -= 1.4 if not many else 0.2
    if small and (low in SAYING or low in KIN or low in ASKING or low in LOOSE_HEADS):
        x -= 4.0
    return logistic(x)
