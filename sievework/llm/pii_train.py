"""Training of the tagger of ``pii``: labelled spans from a sentence grammar, and a BiLSTM-CRF fitted with Adam, in numpy.

    python -m sievework.llm.pii_train MINUTES            from random weights
    python -m sievework.llm.pii_train MINUTES resume     on from the stored weights, at a lower learning rate
    python -m sievework.llm.pii_train 0                  figures of the stored weights on the held-out grammar

The rows are an endless stream made here with fixed seeds: names, streets and domains are invented or common ones, contexts
are composed of short cues and ordinary English (words and sentences of the documentation that comes with Python). No
table of this project is read, and none of the longer literals, names, streets or domains below stands in one (a test sees
to that). ``HeldOut`` makes rows from cues, names, streets and domains that ``Maker`` doesn't know; figures come from it.
Gradients of a step are computed by several processes, each on rows of its own, and averaged.
"""

from __future__ import annotations

import os
import random
import re
import sys
import time
from functools import lru_cache

for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
    os.environ.setdefault(_name, "1")  # one thread a process; the processes share the work

import numpy as np  # noqa: E402

from sievework.llm.pii import KINDS, REACH, SHAPES, SIZE, TAGS, WEIGHTS, Tokens, small_symbols, symbol_table  # noqa: E402

#: Sizes: of a character, convolutions, a word, a form, the states; rows of a step, characters of a row and of a token.
CHAR, CONV, WORD, FORM, HIDDEN, ROWS, LONGEST, LETTERS = 16, 64, 16, 12, 40, 48, 320, 24
#: Share of features left out of a step at random, and the most of the known words (another share for each step).
DROPPED, UNKNOWN = 0.15, 0.9
#: Times a word stands in the sample (outside names) to be a known one, and rows of the sample.
OFTEN, SAMPLE = 12, 60_000
#: Weight of the former mean of the weights in the one that is kept.
KEPT = 0.999
SEED = 31

GIVEN = (
    "Abigail Adebayo Agnes Aiden Aisling Akira Aleksander Alice Alina Alistair Amelie Amir Angela Anil Antonia Arjun Arthur Astrid Aurora Axel Barnaby Basil Bettina Bianca Bjorn Bogdan Brigitte Bruno Camila "
    "Carmen Caspian Cecilia Celeste Chidi Claire Claudia Clemens Colette Conrad Cordelia Cyril Dagmar Daphne Darius Deepak Delphine Denise Diego Dorian Douglas Eamon Edith Eduardo Egon Eileen Elena Elias Elisabeta "
    "Emil Enrique Erik Esther Eugenia Fabian Felicity Fergus Fernanda Fiona Florian Francesca Gareth Gemma Genevieve Gerald Giorgio Gloria Goran Greta Gunther Hamid Hannah Harold Hector Heidi Henrietta Hiroshi Hugo Ian "
    "Ilse Imogen Irena Isabel Ivan Jacek Jamal Janina Jasper Javier Jerome Jill Joachim Jocelyn Jorge Julien Juno Karim Katarina Kenji Kerstin Kieran Klara Klaus Kofi Lakshmi Laszlo Leila Leon Lionel Lorenzo Louise "
    "Lucinda Ludmila Magda Malik Manuel Marguerite Martin Matilda Maxim Mei Mercedes Milan Miriam Mohammed Monika Nadia Naomi Natasha Nathaniel Nikolai Norbert Octavia Odette Olivia Orla Oscar Otto Pablo Pascal Paula "
    "Pedro Penelope Phoebe Quentin Rachel Rashid Regina Reinhard Rhys Roland Rosalind Roxana Ruben Ruth Sabine Salma Samir Sandra Sanjay Saskia Sebastian Sergei Sheila Shirin Silas Simone Solveig Sonia Stella Stuart "
    "Tamara Tariq Teresa Thandiwe Tiago Timothy Trudy Ulrich Ursula Valentin Vera Viktor Vincent Vivian Walter Wanda Wilhelm Xavier Yasmin Yolanda Yuki Zachary Zainab Anaïs André Björn Chloé Désirée Élise François "
    "Hélène Jérôme Jörg László Léa Mónica Núria Øystein Raúl Sören Thérèse Ümit Jean-Luc Anne-Marie Karl-Heinz Mary-Jane Marie-Claire Ye-jin Min-ho Soo-ah"
).split()
SURNAMES = (
    "Abbott Achebe Adeyemi Agarwal Albrecht Almeida Andersson Aoki Armitage Atkinson Bailey Banerjee Barlow Bauer Becker Bellini Bennett Bergstrom Bianchi Blackwood Blanchard Bondarenko Boucher Bradshaw Brandt Brennan Burgess "
    "Calloway Campbell Cardoso Carmichael Chatterjee Chaudhry Chavez Clarke Coleman Connolly Contreras Crawford Cruickshank Czerny Dalgaard Davenport Delacroix Delgado Desai Dhillon Donoghue Dreyer Dufour Eastman Edmonds "
    "Eklund Engel Eriksen Escobar Farrell Faulkner Ferreira Fielding Fischer Fitzgerald Fontaine Forsythe Fournier Franzen Fujimoto Galloway Gallagher Gauthier Geiger Gibson Goldberg Gonzalez Goodwin Grabowski Grimaldi "
    "Gupta Gutierrez Hagen Halvorsen Hamilton Hargreaves Hartmann Hashimoto Hawthorne Henriksen Herrera Hoffmann Holloway Horvath Hussain Ibrahim Ivanova Jablonski Jankowski Jennings Johansson Kaminski Kapoor Karlsson "
    "Kavanagh Keller Kimura Kirchner Koroma Kovacs Kozlov Kruger Lachance Lambert Langley Larkin Lefebvre Lehmann Lindholm Lombardi Lopes Lundgren MacDonald Machado Magnusson Mahoney Malhotra Marchand Marquez Mathews "
    "Mazur McAllister McCarthy McIntyre Mendoza Mercier Mitchell Moreau Moretti Morozova Mueller Mukherjee Nakamura Navarro Nielsen Nikolaidis Norwood Novotny Nowicki Obi O'Brien O'Connor Odhiambo Oliveira Olsen Ortega "
    "Osborne Pacheco Papadopoulos Pavlenko Pearce Pellegrini Petersen Pickering Popescu Quigley Radcliffe Ramirez Rasmussen Reinhardt Renard Richter Ridgeway Rinaldi Rodrigues Romero Rosenthal Rousseau Ruiz Salazar Samuelsson "
    "Santiago Sato Schneider Schreiber Serrano Sharma Sheridan Sinclair Sokolov Sorensen Stapleton Steiner Sutherland Svensson Szabo Takahashi Tanaka Thibault Thompson Thornton Torres Tremblay Underwood Valverde Vandermeer "
    "Vasquez Vaughan Venkatesan Villeneuve Vogel Volkova Wagner Walczak Watanabe Weatherby Weber Wentworth Whitaker Wilkinson Wojcik Woodhouse Yamada Yilmaz Zamora Zielinski Zimmermann Bäcker Béranger Çelik Günther Köhler "
    "Nuñez Peña Żak Łukasik de_Vries van_den_Berg da_Costa ter_Horst"
).split()
SYLLABLES = "ba be bel bor bru cal car cor da del dor dra el en er fal fer fin gal gan gor gra har hel hol is jar jor ka kel kin la lan len lor mal mar mel mon mor nan nel nor ol or pal per pol ra ren rin rol sal san sel sol ta tal tan ter tor ul van ver vol wal wen wil yor zan".split()
SURNAME_ENDS = "son sen ski ska man mann berg stein wood well ton ley field worth by ov ova enko ic ez ini elli ard eau aux er ier ard away more mont ford hurst sky dal gaard lund quist".split()
GIVEN_ENDS = "a ia ina elle ette o io ian en an el ius us y ie ine on or in is as eth ara ora".split()
PLACES = "Alder Amber Barrow Bever Black Brook Cald Clay Copper Dart Dun Earl Farn Glen Gold Grim Hart Hazel High Hunt Kings Lang Long Mans Nether Oak Red River Sand Sher Silver South Stan Stoke Swan Thorn Upper Wat West Whit Wolf".split()
PLACE_ENDS = "ford ham bury ton ley brook bridge wood well worth by thorpe cliffe stone hill burn land more ridge side water ness beck den hurst lake vale view pool cross castle".split()
TOWNS = "Aberdeen Antwerp Arhus Basel Bilbao Bologna Bratislava Brno Cardiff Cork Dallas Denver Dundee Eindhoven Exeter Galway Gdynia Ghent Graz Innsbruck Leeds Leiden Linz Lisbon Lucerne Lugano Malmo Mobile Nairobi Oslo Oxford Parma Perth Porto Reno Rotterdam Salem Stirling Tampa Tampere Trieste Tucson Turin Utrecht Venice Warsaw York London Boston".split()
REGIONS = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY ON QC BC NSW VIC QLD".split()
STREETS = (
    "Acacia Albion Alma Arundel Ashgrove Aspen Beaumont Birch Bluebell Bramble Briar Brunswick Cambridge Canal Castle Cavendish Cedar Chapel Charlotte Cherry Chestnut Clarence Clifton Coronation Cypress Dogwood Elder Elm Eastfield Falcon "
    "Fern Foundry Garden Glebe Gladstone Grange Greenwood Hawthorn Hazelwood Heather Holly Hickory Ivy Jubilee Kingfisher Laburnum Larch Laurel Lavender Lime Linden Magnolia Manor Mulberry Myrtle Nelson Nightingale "
    "Northgate Osprey Palmerston Pine Poplar Primrose Prince's Queen's Rectory Regent Rosewood Rowan Royal Salisbury Sandringham Shepherd Spruce St_John's Stanley Sycamore Trinity University Vicarage Victoria Walnut "
    "Washington Wellington Westbourne Willow Windmill Windsor Woodland 2nd 3rd 5th 7th 12th 42nd"
).split()
STREET_KINDS = "Street Street St St. Road Road Rd Rd. Avenue Avenue Ave Ave. Lane Lane Ln Drive Drive Dr Court Ct Row Blvd Blvd. Boulevard Way Place Pl Close Terrace Crescent Square Gardens Grove Mews Passage Parade Circle Parkway Highway Walk Hill Rise Green Alley Wharf Quay".split()
GERMAN_STEMS = "Ahorn Amsel Birken Blumen Buchen Dorf Eichen Feld Fichten Friedrich Goethe Hafen Kaiser Kloster Mozart Mühlen Quellen Rosen Schiller Sonnen Tannen Ufer Wald Wiesen Ziegel".split()
GERMAN_ENDS = "straße strasse str. weg gasse allee platz ring damm".split()
FRENCH_KINDS = "rue_de_la rue_du rue_des rue_de_l' avenue_de_la avenue_du boulevard_de_la boulevard_des impasse_des chemin_du place_de_la quai_de_la allée_des".split()
FRENCH_STEMS = "République Liberté Fontaine Paix Forêt Plage Victoire Chapelle Colline Rivière Bergers Peupliers Érables Oliviers Cerisiers Pêcheurs Vignes Moissons Château Stade Commerce Parc Marais Pont".split()
SPANISH = "Calle_de_Alcalá Calle_Mayor Avenida_de_la_Constitución Plaza_del_Sol Calle_de_los_Olivos Paseo_del_Prado Via_Roma Via_Garibaldi Corso_Italia Piazza_Dante".split()
DOMAINS = "yahoo.com hotmail.com icloud.com aol.com gmx.net proton.me fastmail.fm zoho.eu live.co.uk btinternet.com orange.fr libero.it posteo.net example.net mail.example.edu staff.acme-works.example people.bluefin.test".split()
TRADES = "Analytics Bank Biotech Capital Chemicals Construction Consulting Design Dynamics Energy Engineering Entertainment Finance Foods Foundation Healthcare Hospital Hotels Industries Institute Instruments Insurance Interactive International Laboratories Logistics Manufacturing Marketing Materials Media Mobility Motors Networks Partners Pharma Properties Publishing Robotics Security Services Shipping Software Solutions Staffing Studios Systems Technologies Telecom Textiles Trading Transport University Ventures".split()
FORMS = "Ltd LLC GmbH Inc Inc. PLC Group S.A. AG Corp Co. & Sons & Partners Holdings B.V. Limited".split()
PRODUCTS = "CRM ERP Suite Cloud Studio Platform Portal Desk Hub Manager Pro Server Assistant Tracker Ledger Payroll Academy Programme Initiative Project Framework Campus Tower House Park Centre Building Award".split()
TITLES = "Mr Ms Mrs Dr Prof Miss Mr. Ms. Mrs. Dr. Prof. Herr Frau".split()
#: Short texts before a finding of each kind; an empty one is as good as any.
BEFORE = {
    "NAME": (
        "ask for|speak with|talk to|report to|led by|run by|managed by|signed by|written by|sent by|posted by|call|meet|met|contact|see|from|with|by|and|to|of|attention:|attn|dear|hello|hi|regards,|sincerely,|kind regards|thanks,|cc|name:|full name:|manager:|author:|referee:|"
        "interviewer:|recruiter|agent|director|manager|supervisor|colleague|assistant|our partner|my cousin|your mentor|head of school|the owner|the landlord|a man called|a woman called|someone calling himself|somebody who says she is|a certain|named|i am|this is|the account of|"
        "payable to|in the name of|on behalf of|addressed to|according to|hosted by|interview with|replies go to|team lead|hiring lead|chair:|candidate|witness|tenant|consultant|nurse|professor|coach|the late|reach|email|phone|ring|please greet|welcome|congratulate|he is|she is|will be|is|was"
    ).split("|"),
    "EMAIL": "email:|e-mail|mail|mail to|email us at|send it to|write us:|reach us on|contact|contact:|reply to|at|via|to|from|or|and|cc|using|address:|inbox|forward everything to|applications to|cv to|resume to|queries:|feedback to|reported by|sender:|sender|account|login|my email is|their mail was|answer came from|it arrived from|under|or by mail|<|(".split("|"),
    "PHONE": "tel|tel.|tel:|phone|phone:|ph.|mobile|mobile:|cell:|fax|call|call:|call us on|dial|ring|text|sms|sms to|whatsapp|telegram|signal|hotline|helpline|office line|direct line|landline|contact|contact:|reach me at|on|at|from|or|or call|under|number|number:|my number is|the number was|caller id|missed calls from|it rang from|message from|by phone:|voicemail|desk phone|(".split("|"),
    "ADDRESS": "at|located at|based at|we are at|visit|visit us:|come to|come by|address:|address|home address|postal address:|ship to|deliver to|sent to|post to|mail to|mail it to|parcel to|returned to|return to|to|of|from|in|near|office:|our office,|the office at|the flat at|lives at|living at|registered at|warehouse:|site:|venue:|meeting point:|headquarters:|moved to|pick up at|drop off at|collect it from|invoice to|bill to|entrance on|opposite|held at|leave it at|write to|residence:".split("|"),
}
ID_LABELS = {
    "ssn": "SSN|ssn|Social|social|social security|social security number|social security no.|Social Security Number|soc. sec. no.|Social Security #",
    "nino": "NI number|NINO|nino|NI no.|national insurance|national insurance number|National Insurance No.|n.i. number",
    "passport": "passport|passport no|passport no.|passport number|Passport|Passport No.|passport #|travel document",
    "licence": "driving licence|driving licence number|driver's license|drivers license|driver's licence no.|licence no.|license number|driving license|DL number|DL no.",
    "card": "identity card|identity card no.|ID card|ID card number|national ID|national id number|id no.|tax id|Personalausweis|DNI",
}
#: Short texts between a label and its number.
LABEL_LINKS = "||:|:| is| was| no:| =| -| (|,| #| reads| as| ends up as| given as".split("|")
AFTER = (
    "||||.|.|,|;|)|!|?| -| and| or| please| today| tomorrow| at noon| on Monday| before Friday| by friday| for details| if needed| as well| only| asap| after work| any time| during office hours| for more| when you can| to apply| first| again| twice| last week|"
    " if you have questions| and say so| who knows more| who replied| wrote to me| called me| says so| will help| will call you| is in charge| signed it| is on leave| joined us| answers mail| never answered| wanted a fee| which looks odd| with a cover letter| and wait| within a week|, thanks|, then wait| (office)| (mobile)| (private)| is fake| is closed| is on the form| was on the letter"
).split("|")

#: Words of work and daily life, for sentences without personal data; ``grown`` adds their inflected forms.
NOUNS = (
    "absence account advert advice agenda airport allowance apprentice archive area assembly audience award badge bakery bank barn basket battery beach bed bench benefit bicycle bill blanket board boat boiler bonus book bottle branch bread breakfast bridge broker brush bucket budget building bus "
    "cabin cable calendar camera campus canteen car care cargo carpet carrier case cashier catalogue ceiling cellar centre ceramic chair change channel charity chart chef child circuit city claim classroom cleaner clerk client climate clinic clock cloth coach coast coffee college commission "
    "community company compost computer concert concrete conference contract contractor conveyor cook copy corner cost cotton council counter country couple course courier cover crane cream crew crop crowd culture cupboard curtain customer cycle dairy damage dashboard database deadline dealer debt deck "
    "degree delay demand dentist department deposit design desk dessert device diary diet dinner diploma director discount dish dispute district doctor door dose draft drawer driver drug dust duty editor education electrician element elevator email employee employer energy engine engineer "
    "entrance envelope equipment estate evening event exam exchange exhibition expense expert export fabric facility factory family farm farmer farmhouse fashion fee feedback fence ferry festival fibre field film filter finance fire fish fleet flight floor florist flour flower folder food football forest forklift form foundation "
    "fraud freight friend fruit fuel fund funding furniture garage garden garment gas gate glass glove goods government grade graduate grain grant graph grass gravel grocery group growth guard guest guide gym hall hammer handbook harvest hazard headset health heating helmet hiring history holiday home hospital "
    "hotel house housing hygiene ice idea illness import income index industry influence information injury ink inspection inspector installation instruction instrument insurance intern interview investment invoice item jacket job journey judge juice kettle key keyboard kitchen knife laboratory labour ladder lamp land language laptop laundry "
    "law lawyer leader leaflet lease leather lecture lecturer legislation lesson letter level library licence lift light liquid list loan locker lodge logistics lorry lunch machine magazine mail maintenance mall manager manual map market marketing mask material meal meat mechanic media medicine meeting member memo menu merchandise mentor message metal "
    "midwife milk mine minute model money month mortgage motor museum music nanny network newspaper night noise notice number nurse nursery oak oil officer opinion optician orchard order outcome outlet oven overtime owner package packaging page paint painter pallet panel paper parcel parent parking partner passenger patient payment payroll pension people "
    "performance permit pharmacist pharmacy photo physiotherapist picture pipe pipeline plan plane plant plaster plastic platform plumber policy pool port porter portfolio poster pottery power practice premium prescription presentation press price printer prison problem procedure process produce product profile profit programme project promotion property proposal prototype pump purchase "
    "quality quantity query question queue quota radio rail ramp range rate reader receipt reception recipe recruitment reference refund region register regulation rehearsal relief rent repair report request research reservation resident response restaurant result retail retirement return revenue review reward rice risk river road robot roof room roster route rubber rule safety salad "
    "salary sale salon sample sand satellite scaffold schedule scheme scholarship school science scooter score screen sculpture seat section security seed seminar service session share sheet shelf shelter shift ship shirt shoe shop shower signal site skill soap software soil solution sound soup spare species spreadsheet stable staff stage stairs stall standard statement station steel stock storage store "
    "strategy stream street student studio style subscription subsidy suburb sugar supervisor supply support surgeon surgery survey switch system table tablet tailor talent tank target tariff task tax taxi tea teacher team technician technology telephone temperature template tenant tender tent terminal test textile theatre therapy ticket tile timber time timetable tool tourist tower town toy tractor trade traffic trailer train trainer training "
    "translation transport travel treatment tree trial trip truck tunnel tutor tyre uniform union unit university upgrade vacancy vaccine valve van vegetable vehicle vendor venue vessel veteran video village visa visitor voucher wage waiter wall ward wardrobe warehouse warranty washing waste watch water weather website wedding week weekend welfare wheel window winter wire wood wool work worker workflow workshop yard year youth zone"
).split()
VERBS = (
    "accept adapt add adjust advise allocate analyse answer appoint appraise arrange ask assemble assess assign assist attend bake balance bid book brief bring build buy calculate call carry check choose clean clear climb coach coat code collect compare compile complete compose conduct confirm connect consult control convert cook coordinate copy count create cut deal decide decorate deliver demonstrate describe design detect develop dig direct "
    "discuss dispatch display distribute draw drill drive earn edit embed encourage enter estimate evaluate examine expand explain explore export extract face fasten feed file fill find finish fit fix fold follow forward gather give grade greet grow guide handle harvest help hold host identify implement improve increase inform inspect inspire install instruct interpret introduce invest iron keep know launch lay lead learn leave lend lift link list listen load look maintain make manage "
    "map mark market measure meet mend mentor merge mix model mount move negotiate note notify observe obtain offer open operate order organise oversee own pack paint park pass pay perform phone photograph pick pilot place plan plant polish post pour practise predict present press prevent price print produce promote propose protect prove publish purchase raise read receive recommend record recruit reduce refer refresh register remove renew rent repair replace report represent request research resolve respond restock "
    "revise ride route run sail schedule score screen seal search secure select sell send serve service set sew share shift ship show sign solve sort speak sponsor stack start steer stitch stop store stretch study submit suggest supervise supply survey switch take talk taste teach test think tidy track trade train translate transport travel treat trim tune type understand unload update upload use verify visit wait walk want warn wash watch weigh welcome weld win work wrap write"
).split()
ADJECTIVES = (
    "able accurate active additional adult affordable agile agricultural ambitious annual artistic attentive automatic available average basic bold brave brief bright broad busy calm careful casual central certified cheerful chemical civil clean clear clever clinical cold commercial common competent competitive complete complex confident consistent constant contented cooperative core creative critical curious current daily decent dedicated deep dependable diligent "
    "digital direct discreet domestic double durable eager early eastern easy economic efficient electric electronic energetic enthusiastic environmental equal essential excellent exciting experienced expert extensive external fair faithful familiar fast federal financial fine firm first fit fixed flexible fluent formal free frequent fresh friendly full future general generous gentle genuine global good graphic great green happy hard healthy heavy helpful high honest hot human humble immediate independent individual industrial "
    "informal innovative inner intensive internal international joint junior keen key kind large last late lasting legal level light likely linguistic little lively local logical long loud low loyal main major manual marine maximum mechanical medical mental methodical minimum minor mobile modern modest monthly motivated multiple municipal musical narrow national natural neat new nice nocturnal northern numerous occasional official old open optional organised original outdoor overall paid "
    "parental part-time passionate patient permanent personal physical pleasant polite popular positive potential practical precise preferred premium previous primary private proactive productive professional proper proud public punctual pure quick quiet random rapid rare ready real reasonable recent regional regular relevant reliable remote resilient resourceful responsible retail rich rural safe seasonal second secondary senior sensible serious sharp short significant similar simple single skilled slow small smart social soft solid southern special specific stable standard steady "
    "straight strategic strict strong structural suitable sunny supportive sustainable sweet tactful technical temporary thermal thorough thoughtful tidy tough traditional tropical trustworthy typical ultimate unique unpaid urban urgent useful usual valid valuable various versatile vital warm weekly welcome western whole wide willing wise worthwhile written young"
).split()
ADVERBS = "always abroad again alone already also annually carefully closely clearly daily directly early easily efficiently either elsewhere evenly fairly forever formally fully generally gladly here hourly indoors instead jointly just kindly late lately later locally mainly maybe meanwhile monthly mostly nearly never nightly now nowadays often once online only openly outdoors overnight partly perhaps politely promptly properly quickly quite rather regularly remotely safely seldom soon sometimes somewhere steadily still straight sure there thoroughly together tonight twice usually very weekly well yearly".split()
NATIONS = "American Australian Austrian Belgian Brazilian British Bulgarian Canadian Chinese Croatian Czech Danish Dutch Egyptian English European Finnish French German Greek Hungarian Indian Irish Italian Japanese Kenyan Korean Latin Mexican Nordic Norwegian Polish Portuguese Romanian Russian Scottish Spanish Swedish Swiss Turkish Ukrainian Welsh".split()
MONEY = "dollars euros pounds francs crowns rupees yen pesos dinars cents pence shillings zloty lira krona".split()
CALENDAR = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December Easter Christmas Excel Python Java English Bluetooth Windows Linux Word Internet Europe Africa Asia America".split()
LITTLE = "a the our your their its this that each every some any no one two three many few most other another such both all".split()
BETWEEN = "of for in at on by with from to about after before during without within through under over between against across around beyond near per and or but as than while when if because so that which who where".split()
LEADS = "we you they it someone everyone nobody anyone people somebody he she i who there this that these those everybody".split()
MODALS = "can will may must should would could might do did need to|want to|help to|like to|have to|are able to|plan to|try to|used to|learn to|seem to|agree to".replace(" to|", "_to|").replace("|", " ").split()


def grown(nouns: list[str], verbs: list[str], adjectives: list[str]) -> dict[str, list[str]]:
    """The words with their regular forms: plurals, -s, -ing, -ed, -er, -ly, -ness, un-, re-, over- and joined words."""
    plural = lambda w: w + "es" if w[-1] in "sxz" or w.endswith(("ch", "sh")) else w[:-1] + "ies" if w[-1] == "y" and w[-2:-1] not in "aeou" else w + "s"
    stem = lambda w, end: w[:-1] + end if w[-1] == "e" else w + end
    past = lambda w, end: w[:-1] + "i" + end if w[-1] == "y" and w[-2:-1] not in "aeou" else stem(w, end)
    return {
        "noun": nouns + nouns + [plural(w) for w in nouns],
        "actor": [past(w, "er") for w in verbs] + [past(w, "ers") for w in verbs],
        "verb": verbs + verbs + [plural(w) for w in verbs] + ["re" + w for w in verbs[::4]] + ["over" + w for w in verbs[::7]],
        "ing": [stem(w, "ing") for w in verbs],
        "ed": [past(w, "ed") for w in verbs],
        "adjective": adjectives + adjectives + ["un" + w for w in adjectives[::5]] + [w + "-" + stem(v, "ing") for w, v in zip(adjectives[::3], verbs)] + [n + "-" + past(v, "ed") for n, v in zip(nouns[::5], verbs[::-1])] + [past(w, "er") for w in adjectives if len(w) < 6],
        "ness": [past(w, "ness") for w in adjectives[::3]],
        "adverb": ADVERBS + [past(w, "ly") for w in adjectives if not w.endswith(("ly", "le"))],
    }


@lru_cache(maxsize=1)
def ordinary() -> tuple[list[str], list[str]]:
    """Words and plain sentences of the documentation of the Python language and its standard library."""
    import importlib
    import pydoc

    from pydoc_data import topics

    texts = list(topics.topics.values())
    for name in "argparse ast asyncio calendar collections csv datetime decimal difflib email functools gettext heapq html http imaplib inspect io ipaddress itertools json locale logging mailbox math multiprocessing os pathlib pickle platform random re sched shutil smtplib socket sqlite3 ssl statistics string subprocess tarfile tempfile textwrap threading tkinter tokenize typing unittest urllib uuid venv warnings wave weakref xml zipfile zoneinfo".split():
        try:
            module = importlib.import_module(name)
        except ImportError:
            continue
        texts.append(module.__doc__ or "")
        texts += [pydoc.getdoc(x) for x in vars(module).values() if callable(x)]
        texts += [pydoc.getdoc(y) for x in vars(module).values() if isinstance(x, type) for y in vars(x).values() if callable(y)]
    joined = re.sub(r"[ \t]*\n[ \t]*(?=\S)", " ", "\n\n".join(dict.fromkeys(texts)))
    sentences = sorted({s for s in re.findall(r"(?<![\w\"'`.])[A-Z][a-z]+(?:,? [a-z][a-z'-]*){3,24}\.(?=\s|$)", joined)})
    words = sorted({w.strip("'-") for s in sentences for w in re.findall(r"(?<!\w)[a-z][a-z'-]+", s) if len(w) > 1})
    return words, sentences


class Maker:
    """Random sentences with labelled spans."""

    given_names, surnames, streets, domains, towns, before = GIVEN, SURNAMES, STREETS, DOMAINS, TOWNS, BEFORE
    known = 0.45  # share of names from the lists, the rest is invented
    nouns, verbs, adjectives = NOUNS, VERBS, ADJECTIVES

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.words, self.sentences = ordinary()
        self.forms = grown(self.nouns, self.verbs, self.adjectives)

    def pick(self, options) -> str:
        return self.r.choice(options).replace("_", " ")

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def made(self, low: int, high: int, end: str = "") -> str:
        return ("".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(low, high))) + end).capitalize()

    def place(self) -> str:
        x = self.r.random()
        town = self.pick(PLACES) + self.pick(PLACE_ENDS) if x < 0.55 else self.pick(self.towns) if x < 0.75 else self.made(1, 3, self.pick(PLACE_ENDS)) if x < 0.9 else self.made(2, 3)
        return self.pick(["New", "Port", "Saint", "St", "Fort", "Lake", "Mount", "Great", "Upper", "Bad", "San"]) + " " + town if self.chance(0.1) else town

    def org(self) -> str:
        x = self.r.random()
        head = self.made(2, 3) if x < 0.6 else self.pick(self.surnames) if x < 0.8 else f"{self.pick(self.surnames)} & {self.pick(self.surnames)}"
        if self.chance(0.1):
            head = f"{self.pick(self.given_names)} {self.pick(self.surnames)} & {self.pick(['Sons', 'Daughters', 'Co', 'Partners', 'Associates'])}"
        name = head + self.pick(["", " " + self.pick(TRADES), " " + self.pick(TRADES), " " + self.pick(TRADES) + " " + self.pick(TRADES)]) + self.pick(["", "", " " + self.pick(FORMS)])
        if self.chance(0.1):
            name = f"{self.pick(TRADES)}, {self.made(2, 3)}" + self.pick(["", "", " " + self.pick(FORMS)])
        return name.upper() if self.chance(0.08) else name

    def product(self) -> str:
        return self.pick([self.made(2, 3) + " " + self.pick(PRODUCTS), self.pick(self.words).capitalize() + " " + self.pick(PRODUCTS), "Project " + self.made(2, 3), "Project " + self.made(2, 3) + " " + self.made(2, 3), self.made(2, 3), self.pick(self.words).capitalize() + " " + self.pick(self.words).capitalize()])

    def given(self) -> str:
        return self.pick(self.given_names) if self.chance(self.known) else self.made(1, 2, self.pick(GIVEN_ENDS)) if self.chance(0.7) else self.made(2, 3)

    def surname(self) -> str:
        one = lambda: self.pick(self.surnames) if self.chance(self.known) else self.made(1, 2, self.pick(SURNAME_ENDS)) if self.chance(0.6) else self.made(2, 4)
        return one() + ("-" + one() if self.chance(0.12) else "")

    def name(self) -> str:
        g, s, x = self.given(), self.surname(), self.r.random()
        i = self.r.choice("ABCDEFGHIJKLMNOPRSTVWZ") + "."
        form = f"{g} {s}" if x < 0.5 else f"{s}, {g}" if x < 0.64 else f"{g[0]}. {s}" if x < 0.78 else f"{g} {i} {s}" if x < 0.9 else f"{g[0]}. {i} {s}" if x < 0.94 else f"{s}, {g[0]}." if x < 0.97 else f"{g} {self.given()} {s}"
        y = self.r.random()
        return form.upper() if y < 0.1 else form.lower() if y < 0.22 else form

    def email(self) -> str:
        import unicodedata

        low = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t).lower() if c.isascii() and (c.isalnum() or c == "-"))
        g, s, d = low(self.given()).replace("-", ""), low(self.surname()), self.digits
        w = self.pick(self.words).replace("'", "")
        local = self.r.choice([f"{g}.{s}", f"{g}.{s}", f"{g}.{s}{d(2)}", f"{g[0]}{s}", f"{g[0]}.{s}", f"{g}_{s}", f"{g}_{s}{d(2)}", f"{s}.{g}", f"{s}.{g}+{w}", f"{g}{d(3)}", f"{g}{d(2)}", f"{s}{d(4)}", f"{g}-{s}", w, f"{w}.{s}", f"{s}+{w}{d(1)}", f"{g}.{s[0]}.{s}", g, g[0], g[0] + s[0]])
        domain = self.pick(self.domains) if self.chance(0.5) else self.r.choice(["", "", "", "mail.", "hr.", "post."]) + self.r.choice([self.made(2, 3).lower(), w, w[0], w[:2], w + "-" + self.pick(self.words).replace("'", "")]) + self.r.choice([".example", ".test", ".com", ".org", ".co.uk", ".net", ".de", ".fr", ".io", ".biz", ".com.au", ".example.org"])
        if self.chance(0.12):
            local = local.upper()
            domain = domain.upper() if self.chance(0.4) else domain
        if self.chance(0.6):
            return f"{local}@{domain}"
        at = self.r.choice([" (at) ", " [at] ", " at ", " at ", "(at)", "[at]", " AT ", " (AT) ", " @ "])
        dot = self.r.choice([" dot ", " dot ", " [dot] ", " (dot) ", "(dot)", "[dot]", "."]) if at not in (" at ", " AT ") else self.r.choice([" dot ", " dot ", " [dot] ", " (dot) "])
        return local + at + domain.replace(".", dot)

    def phone(self) -> str:
        d, ch = self.digits, self.r.choice
        a, area = ch("23456789") + d(2), d(2)
        kind = self.r.randint(0, 5)
        if kind < 2:  # North America
            s = ch("-- .")
            return ch([f"({a}) {d(3)}-{d(4)}", f"({a}){d(3)}-{d(4)}", f"{a}{s}{d(3)}{s}{d(4)}", f"{a}{s}{d(3)}{s}{d(4)}", f"+1 {a} {d(3)} {d(4)}", f"+1-{a}-{d(3)}-{d(4)}", f"1-{a}-{d(3)}-{d(4)}", f"{a}{d(7)}", f"+1{a}{d(7)}", f"+1 ({a}) {d(3)}-{d(4)}"])
        if kind == 2:  # United Kingdom
            m = ch(["7", "20", "161", "1" + d(3), "7" + d(3)])
            tail = ch([f"{d(3)} {d(3)}", f"{d(6)}", f"{d(3)} {d(4)}", f"{d(4)} {d(4)}"])
            return ch([f"0{m} {tail}", f"0{m}{tail}", f"+44 {m} {tail}", f"+44 (0){m} {tail}", f"+44{m}{tail}", f"0044 {m} {tail}", f"(0{m}) {tail}"])
        if kind == 3:  # Germany, Austria
            m = ch([area, d(3), "1" + d(2)])
            return ch([f"+49 {m} {d(5)} {d(3)}", f"+49 {m} {d(7)}", f"0{m}/{d(6)}", f"0{m} {d(7)}", f"+49 (0){m} {d(6)}", f"0{m}-{d(7)}", f"+43 {m} {d(6)}"])
        if kind == 4:  # France
            return ch(["+33 " + ch("12345679"), "0" + ch("12345679"), "+33 (0)" + ch("12345679")]) + "".join(ch([" ", " ", " "]) + d(2) for _ in range(4)) if self.chance(0.8) else "0" + ch("1234567") + "".join("." + d(2) for _ in range(4))
        return ch([f"+{d(2)} {d(2)} {d(3)} {d(4)}", f"+{d(3)} {d(3)} {d(6)}", f"+{d(2)} {d(10)}", f"+{d(2)}-{d(2)}-{d(4)}-{d(4)}", f"00{d(2)} {d(3)} {d(7)}", f"0{d(4)} {d(6)}", f"0{d(4)} {d(3)} {d(3)}", f"+{d(12)}"])

    def identity(self) -> tuple[str, str]:
        d, ch = self.digits, self.r.choice
        kind = ch(["ssn", "nino", "passport", "licence", "licence", "card"])
        up = lambda n: "".join(ch("ABCDEGHJKLMNPRSTWXYZ") for _ in range(n))
        if kind == "ssn":
            a = ch(["000", d(3), d(3)])
            number = ch([f"{a}-{d(2)}-{d(4)}", f"{a}-{d(2)}-{d(4)}", f"{a} {d(2)} {d(4)}", f"{a}{d(6)}"])
        elif kind == "nino":
            q, e = up(2) if self.chance(0.7) else "QQ", ch("ABCD")
            number = ch([f"{q} {d(2)} {d(2)} {d(2)} {e}", f"{q}{d(6)}{e}", f"{q} {d(6)} {e}", f"{q}-{d(2)}-{d(2)}-{d(2)}-{e}"])
        elif kind == "passport":
            number = ch([f"{up(1)}{d(8)}", f"{d(9)}", f"{up(1)}{d(7)}", f"{up(2)}{d(7)}", f"{up(1)}{d(2)} {d(3)} {d(3)}", f"{d(2)}{up(2)}{d(5)}"])
        elif kind == "licence":
            a = up(1)
            number = ch([f"{a}{d(3)}-{d(4)}-{d(4)}", f"{a}{d(3)} {d(4)} {d(4)}", f"{a}{d(12)}", f"{a}{d(7)}", f"{d(8)}", f"{up(5)}{d(6)}{up(2)}{d(1)}{up(2)}", f"{a}{d(2)}-{d(2)}-{d(4)}", f"{a}{d(3)}-{d(3)}-{d(2)}-{d(3)}-0"])
        else:
            number = ch([f"{d(8)}{up(1)}", f"{up(1)}{d(8)}", f"{d(9)}", f"{up(2)}{d(6)}", f"{d(3)} {d(3)} {d(3)}", f"{up(1)}{d(3)}{up(2)}{d(3)}"])
        if self.chance(0.08):
            number = number.lower()
        return self.pick(ID_LABELS[kind].split("|")), number

    def address(self) -> str:
        d, ch, r = self.digits, self.r.choice, self.r
        n = str(r.randint(1, 999) if self.chance(0.85) else r.randint(1000, 9999)) + ch(["", "", "", "", "", "A", "B", "c", "-" + d(1)])
        town, five, x = self.place(), d(5), r.random()
        uk = ch("ABCDEGHKLMNOPRSTW") + ch(["", ch("ABDEGHLNRSTUVW")]) + str(r.randint(1, 29)) + " " + d(1) + ch("ABDEFGHJLNPQRSTUWXYZ") + ch("ABDEFGHJLNPQRSTUWXYZ")
        region = ch(REGIONS) if self.chance(0.6) else ch("ABCDEGHKLMNOPQRSTVW") + ch("ABCDGHKLMNOPQRSTWXY")
        if x < 0.1:
            out = f"{ch(['P.O. Box', 'P.O. Box', 'PO Box', 'P. O. Box', 'Post Office Box', 'Box'])} {d(r.randint(2, 5))}, {town}" + ch([f" {five}", f" {five}", "", f", {region} {five}"])
        elif x < 0.23:
            street = ch([self.pick(GERMAN_STEMS) + ch(GERMAN_ENDS), self.pick(GERMAN_STEMS) + ch(GERMAN_ENDS), self.made(2, 3) + ch(GERMAN_ENDS), "Am " + ch(["Alten ", "Neuen ", "Großen ", "Hohen ", ""]) + self.pick(GERMAN_STEMS), "An der " + self.made(2, 2), self.made(2, 3) + "er Straße"])
            out = f"{street} {n}, {five} {town}"
        elif x < 0.36:
            kind, stem = self.pick(FRENCH_KINDS), self.pick(FRENCH_STEMS) if self.chance(0.7) else self.made(2, 3) + "s"
            street = kind + ("" if kind.endswith("'") else " ") + stem
            out = f"{n} {street}, {five} {town}" if self.chance(0.85) else f"{n}, {street}, {five} {town}"
        elif x < 0.4:
            out = f"{self.pick(SPANISH)}{ch([' ', ', '])}{n}, {five} {town}"
        else:
            street = self.pick(self.streets) if self.chance(0.6) else self.made(2, 3) if self.chance(0.6) else self.pick(self.words).capitalize() + ch(["", " " + self.pick(self.words).capitalize()])
            if self.chance(0.08):
                street = ch(["Old ", "North ", "E. ", "West ", "Upper ", "N ", "S. "]) + street
            street = f"{n} {street} {self.pick(STREET_KINDS)}"
            unit = f"{ch(['Unit', 'Flat', 'Apt', 'Apt.', 'Suite', 'Apartment', 'Room', 'Floor', '#'])} {r.randint(1, 60)}{ch(['', '', '', 'B', 'a'])}".replace("# ", "#")
            if self.chance(0.18):
                street = f"{unit}, {street}"
            elif self.chance(0.22):
                street += f", {unit}" if self.chance(0.8) else f" {unit}"
            tail = ch([f", {town}", f", {town}", f", {town}, {region} {five}", f", {town} {region} {five}", f", {town}, {region}", f", {town} {five}", f", {town} {uk}", f", {town}, {uk}", f", {five} {town}", f" in {town}", f" in {town}", ""])
            out = street + tail
        y = r.random()
        return out.lower() if y < 0.14 else out.upper() if y < 0.17 else out

    def plain(self, low: int, high: int) -> str:
        """Ordinary words; now and then with a number or the name of a firm, product or place."""
        if self.chance(0.3):
            words = self.clause().split()[-high:]
        elif self.chance(0.4):
            words = self.r.choice(self.sentences)[:-1].split()
            n = self.r.randint(low, max(low, high))
            at = self.r.randint(0, max(0, len(words) - n))
            words = words[at : at + n]
        else:
            words = [self.r.choice(self.words) for _ in range(self.r.randint(low, high))]
        if self.chance(0.25):
            words.insert(self.r.randint(0, len(words)), self.r.choice([str(self.r.randint(1, 999)), self.r.choice(["$", "£", "€"]) + self.digits(3) + self.r.choice(["", "0", ",000"]), self.digits(1) + self.r.choice([" percent", "%", " years", " days"])]))
        if self.chance(0.22):
            words.insert(self.r.randint(0, len(words)), self.r.choice([self.org, self.product, self.place, lambda: self.made(2, 3)])())
        return " ".join(words)

    def thing(self) -> str:
        """What a sentence is about: words of work with or without an article, now and then a firm, product or place."""
        f, x = self.forms, self.r.random()
        if x < 0.12:
            return self.pick(["", "", "the ", "our ", "your ", "a "]) + self.r.choice([self.org, self.product, self.place, lambda: self.made(2, 3), lambda: self.made(2, 4), lambda: self.made(2, 3) + " " + self.pick(f["noun"])])()
        if x < 0.18:
            return self.r.choice([self.pick(NATIONS + ["US", "UK", "EU"]) + " " + self.pick(MONEY), self.pick(NATIONS) + " " + self.pick(f["noun"] + MONEY * 20), self.pick(CALENDAR), self.pick(CALENDAR) + " " + self.pick(f["noun"]), self.pick(f["noun"]) + " " + self.pick(CALENDAR), self.pick(f["adjective"]) + " " + self.pick(MONEY), str(self.r.randint(1, 999)) + " " + self.pick(f["noun"]), self.pick(["EU", "UK", "US", "IT", "HR", "VAT", "CV", "PhD", "NHS"]) + " " + self.pick(f["noun"] + MONEY * 9)])
        parts = [self.pick(LITTLE)] if self.chance(0.4) else [str(self.r.randint(2, 999))] if self.chance(0.06) else []
        for kind, p in (("adverb", 0.05), ("adjective", 0.33), ("ed", 0.07), ("ing", 0.1), ("noun", 0.4), ("noun", 0.06)):
            if self.chance(p):
                parts.append(self.pick(f[kind]))
        return " ".join(parts + [self.pick(f[self.r.choice(["noun", "noun", "noun", "noun", "noun", "ing", "actor", "ness", "adjective"])])])

    def clause(self) -> str:
        f, x = self.forms, self.r.random()
        verb = lambda: (self.pick(MODALS) + " " if self.chance(0.3) else "") + self.pick(f[self.r.choice(["verb", "verb", "verb", "ed", "ing"])]) + (" " + self.pick(f["adverb"]) if self.chance(0.12) else "")
        if self.chance(0.05):
            return self.pick(f["verb"]) + " " + self.made(2, 4) + self.pick(["", " " + self.pick(BETWEEN) + " " + self.thing(), " " + self.pick(f["noun"]), ", " + self.thing()])
        if self.chance(0.03):
            return f"{self.thing()}, {self.pick(['room', 'hall', 'desk', 'bay', 'gate', 'lab'])} {self.r.randint(1, 999)}, {self.pick(['floor', 'level', 'wing', 'block'])} {self.r.randint(1, 40)}"
        out = f"{self.pick(LEADS)} {verb()} {self.thing()}" if x < 0.3 else f"{self.thing()} {verb()} {self.thing()}" if x < 0.55 else f"{verb()} {self.thing()}" if x < 0.7 else f"{self.thing()} {self.pick(['is', 'are', 'was', 'were', 'has', 'have', 'gets', 'means', 'stays', 'becomes'])} {self.pick(f[self.r.choice(['adjective', 'ed', 'ing', 'adverb'])])}" if x < 0.85 else self.thing()
        for _ in range(self.r.choice([0, 0, 1, 1, 2])):
            out += self.pick([" ", " ", " ", " ", ", "]) + self.pick(BETWEEN) + " " + self.thing()
        if self.chance(0.1):
            out += ", " + self.thing() + self.pick([", ", " and ", ", and "]) + self.thing()
        return out

    def work(self) -> str:
        """A sentence of one to three clauses about work or daily life, without personal data."""
        out = self.clause()
        for _ in range(self.r.choice([0, 0, 0, 1, 1, 2])):
            out += self.pick([", ", ", ", "; ", ": ", " - ", " and ", " or ", " but ", " so ", " (", ". "]) + self.clause()
        out = (out + ")" if " (" in out and ")" not in out and self.chance(0.8) else out) + self.pick([".", ".", ".", ".", "", "!", "?", "..."])
        return out[0].upper() + out[1:] if self.chance(0.75) else out.lower() if self.chance(0.3) else out

    def heading(self) -> str:
        """Capitalised words of work: headings, titles of posts, skills in a list."""
        f = self.forms
        one = lambda: " ".join(self.pick(f[k]) for k in self.r.choice(["noun", "adjective noun", "noun noun", "noun actor", "ing noun", "adjective noun noun", "adjective noun actor", "ed noun", "ing actor"]).split()).title()
        out = one() if self.chance(0.6) else one() + self.pick([", ", " & ", " and ", " / ", " - ", " of ", " for "]) + one()
        x = self.r.random()
        if x < 0.2:
            return out + self.pick([", ", " - ", " at ", " in ", " | ", " for "]) + self.r.choice([self.org, self.place, self.product, lambda: self.made(2, 3)])()
        if x < 0.4:
            return self.clause().capitalize() + " " + self.pick(["a", "the", "our", "as", "with", "to the", "by the", "into"]) + " " + out + self.pick([".", "", " " + self.pick(BETWEEN) + " " + self.thing() + "."])
        if x < 0.55:
            return ", ".join(self.r.choice([one, one, self.product, lambda: self.made(2, 3), lambda: self.pick(CALENDAR)])() for _ in range(self.r.randint(2, 6))) + self.pick(["", ".", " and more"])
        return out + self.pick(["", "", ":", "!", ": " + self.clause(), " - " + self.clause(), " (" + self.thing() + ")"])

    def decoy(self) -> str:
        """A sentence without personal data, some with numbers, firms and products that might be taken for it."""
        d, ch, r = self.digits, self.r.choice, self.r
        if self.chance(0.35):
            return self.work()
        if self.chance(0.12):
            return self.heading()
        x = r.random()
        if x < 0.22:
            return ch(self.sentences)
        if x < 0.4:
            return self.plain(4, 18).capitalize() + ch([".", ".", "!", "?", ""])
        if x < 0.62:  # firms, products and projects among ordinary words, at any place and with verbs of their own
            thing = ch([self.org, self.org, self.product, self.product, self.place])()
            verb = self.pick("is was grew opened offers needs builds sells hires runs replaced acquired uses supports launched moved expanded joined ships serves leads pays".split())
            return ch(
                [
                    f"{thing} {verb} {self.plain(2, 9)}.", f"{ch(['At', 'For', 'With', 'In', 'Since', 'Through', 'Before', 'Inside'])} {thing}, {self.plain(3, 9)}.", f"{self.plain(2, 8).capitalize()} {ch(['at', 'with', 'for', 'from', 'in', 'by', 'and', 'of', 'to', 'using', 'named'])} {thing}{ch(['.', '', ', ' + self.plain(2, 6)])}",
                    f"The {thing} {ch(['team', 'office', 'project', 'logo', 'website', 'platform', 'programme', 'account', 'brand', 'branch', 'rollout'])} {verb} {self.product()} {self.plain(2, 6)}.", f"{thing} and {self.org()} {self.plain(2, 7)}", f"{ch(['we', 'they', 'i', 'We', 'You', 'Someone'])} {verb} {thing} {self.plain(2, 7)}",
                ]
            )
        label = ch("order order no. invoice invoice no. ticket case reference ref ref. requisition booking form serial batch version room tracking customer claim policy budget line account code part no. sku contract page project vacancy job id permit container flight isbn".split() + ["order number", "invoice number", "ticket number", "cost centre", "Order", "Invoice", "Ticket", "Case", "Reference", "Form", "Requisition"])
        number = ch([d(3) + " " + d(3) + " " + d(3), "20" + d(2) + "-" + d(3) + "-" + d(4), d(8), d(7), d(6), "#" + d(7), "00" + d(6), d(4) + "-" + d(4), d(4) + "-" + d(2) + "-" + d(3), d(3) + "-" + d(2) + "-" + d(4) + "-" + d(2), ch("ABCDXZ") + d(6), ch("ABCDXZ") + d(2) + "-" + d(5), "INV-" + d(6), d(4) + "/" + d(3), d(10), ch("AQTX") + ch("AQTX") + "-" + d(4) + "-" + d(3), d(4) + " " + d(4) + " " + d(4), "v" + d(1) + "." + d(2) + "." + d(1)])
        if x < 0.82:
            return ch([f"{self.plain(1, 6)} {label}{ch([' ', ': ', ' '])}{number}{ch(['', '.', ', ' + self.plain(1, 6), ' ' + self.plain(1, 8)])}", f"{label.capitalize()} {number} {self.plain(2, 8)}.", f"{label} {number}"])
        return ch(
            [
                f"{self.plain(1, 5)} {ch(['on', 'until', 'since', 'by'])} {d(2)}{ch('./-')}{d(2)}{ch('./-')}20{d(2)} {self.plain(1, 5)}", f"{self.plain(1, 4)} {ch(['from', 'between', 'at'])} {d(2)}:{ch(['00', '15', '30'])} {ch(['to', 'and', '-'])} {d(2)}:{ch(['00', '30'])} {self.plain(0, 4)}", f"{self.plain(1, 5)} {d(r.randint(3, 6))} {self.pick(self.words)} and {d(2)} {self.pick(self.words)}",
                f"{self.plain(1, 4)} https://{self.pick(self.words)}.example/{self.pick(self.words)}?id={d(r.randint(3, 9))}", f"{self.plain(1, 4)} www.{self.made(2, 3).lower()}.com/{self.pick(self.words)}", f"{self.plain(0, 4)} @{self.pick(self.words)}_{self.pick(self.words)}{ch(['', d(2)])} {self.plain(1, 4)}", f"meet us at {self.pick(self.words)} {self.plain(1, 4)}", f"{self.plain(1, 4)} @ {d(1)}{ch(['am', 'pm'])} {self.plain(0, 4)}",
                f"{self.plain(0, 4)} {d(r.randint(1, 3))} {ch(['a', 'per', 'an', 'each', 'every'])} {ch(['hour', 'day', 'week', 'month', 'shift', 'piece', 'page', 'person', 'item', 'mile'])} {self.plain(0, 6)}", f"{self.plain(0, 3)} {ch(['room', 'Room', 'hall', 'Hall', 'floor', 'Floor', 'level', 'Level', 'gate', 'Gate', 'desk', 'Desk', 'row', 'page', 'chapter', 'table', 'shelf', 'bay', 'line'])} {d(r.randint(1, 3))}, {ch(['level', 'floor', 'row', 'seat', 'wing', 'page', 'aisle', 'block', 'column', 'door'])} {d(r.randint(1, 2))}{ch(['', '.', ', ' + self.plain(1, 5), ' ' + self.plain(1, 5)])}",
                f"{d(r.randint(1, 3))} {self.plain(2, 8)} {ch(['in', 'for', 'of', 'with', 'within', 'by', 'from'])} {d(r.randint(1, 3))} {self.pick(self.words)} {ch(['', 'in ' + self.place(), 'at ' + self.org()])}",
                f"{self.plain(0, 3)} section {d(1)}.{d(1)}.{d(2)} and {d(3)}({ch('kbc')}) {self.plain(1, 4)}", f"{self.plain(1, 4)} {ch('$£€')}{d(2)},{d(3)} {ch(['-', 'to'])} {ch('$£€')}{d(3)},{d(3)} {self.plain(0, 4)}", f"{d(r.randint(1, 3))} {self.pick(self.words)} {self.pick(self.words)} {ch(['in', 'at', 'near'])} {self.place()}", f"{self.pick(self.words).capitalize()} in {self.place()}, {self.place()} and {self.place()}", f"{self.place()}, {ch(REGIONS)}: {self.plain(2, 6)}", f"{self.place()} {self.pick(STREET_KINDS)} {self.plain(2, 6)}",
            ]
        )

    def one(self, kind: str) -> list[tuple[str, str | None]]:
        """A finding with what introduces it."""
        if kind == "ID":
            label, number = self.identity()
            link = self.pick(LABEL_LINKS)
            link = link if link.endswith("(") else link + " "
            before = self.pick(["", "", "my ", "your ", "the ", "her ", "his ", "their ", "with ", "a copy of ", "and ", "bring "])
            if self.chance(0.08):
                return [(before, None), (number, "ID"), (f" ({label})", None)]
            return [(before + label + link, None), (number, "ID"), (")" if link.endswith("(") else "", None)]
        before = self.pick(self.before[kind]) if self.chance(0.8) else ""
        if before and self.chance(0.25):
            before = before.capitalize()
        gap = "" if not before or before[-1] in "(<" else " "
        title = self.pick(TITLES) + " " if kind == "NAME" and self.chance(0.3) else ""
        value = {"NAME": self.name, "EMAIL": self.email, "PHONE": self.phone, "ADDRESS": self.address}[kind]()
        if kind == "PHONE" and self.chance(0.06):
            return [(before + gap + title, None), (value, kind), (self.pick([" ext ", " ext. ", " x", " extension "]) + self.digits(3), None)]
        return [(before + gap + title, None), (value, kind), (")" if before.endswith("(") else ">" if before.endswith("<") else "", None)]

    def example(self) -> tuple[str, list[tuple[int, int, str]]]:
        text, spans = "", []

        def add(parts) -> None:
            nonlocal text
            for s, kind in parts:
                if kind:
                    spans.append((len(text), len(text) + len(s), kind))
                text += s

        if self.chance(0.1):
            add([(self.pick(["- ", "* ", "• ", "1. ", "> "]), None)])
        if self.chance(0.36):  # nothing to find: most sentences that the network reads are of this kind
            return text + (self.heading() if self.chance(0.1) else self.work()), spans
        if self.chance(0.06):  # a person at the beginning of a sentence, with any verb
            add([(self.pick(["", "", "", self.work() + " "]), None), (self.name(), "NAME"), (" " + self.pick(self.forms[self.r.choice(["verb", "verb", "ed"])]) + " " + self.thing() + self.pick(["", ".", " " + self.pick(BETWEEN) + " " + self.thing() + ".", " ("]), None)])
            if text.endswith("("):
                add([self.one(self.r.choice(["EMAIL", "PHONE"]))[1], (")" + self.pick(["", "."]), None)])
            return text.replace("\n", " "), spans
        for i in range(1 if self.chance(0.7) else 2):
            if i:
                add([(self.pick([". ", ", ", "; ", " - ", " ", "... ", " / "]), None)])
            if self.chance(0.42):
                text += self.decoy()
                continue
            if self.chance(0.6):
                text += self.plain(1, 8) + self.pick([" ", " ", " ", ", ", ": ", " - "])
            for j in range(self.r.choice([1, 1, 1, 2, 2, 3])):
                if j:
                    add([(self.pick([", ", ", ", " ", " (", " / ", " and ", " or ", "; ", " - ", " | ", " at ", " on ", " of ", " with ", ": ", " " + self.plain(1, 4) + " "]), None)])
                add(self.one(self.r.choice(["NAME", "NAME", "NAME", "EMAIL", "PHONE", "PHONE", "ADDRESS", "ADDRESS", "ID"])))
            add([(self.pick(AFTER) if self.chance(0.6) else self.pick([" ", ", ", ". "]) + self.plain(1, 8), None)])
        text = text.replace("\n", " ")
        if not spans and self.chance(0.06):
            text = text.upper() if len(text.upper()) == len(text) else text
        return text, spans


class HeldOut(Maker):
    """Rows with cues, names, streets, domains, towns and words of work that ``Maker`` doesn't have."""

    nouns = "abattoir acoustics allotment anvil aquarium bandage barista beekeeper bursary caravan catering chisel choir cinema cobbler commuter cushion dialect drone easel excavator foyer freezer gallery glazier greenhouse grit haulage heirloom hostel incubator jetty joinery kiosk lathe lifeguard locksmith loom mosaic nozzle orchestra paddock parasol quarry quilt reactor rotation sawmill sediment shuttle skylight spindle sponge stipend syringe tannery toolbox turbine upholstery vineyard voltage wharfage windscreen zoo".split()
    verbs = "abridge accompany adorn bolt braid broadcast calibrate catalogue chisel commute curate dredge engrave excavate fertilise fumigate glaze graft hoist insulate juggle knead lubricate mow narrate nurture outline plaster prune quilt rehearse reupholster sand sculpt simmer solder sterilise tow varnish ventilate weave whisk".split()
    adjectives = "abrasive acoustic amiable aquatic bespoke bilingual botanical buoyant conscientious courteous dexterous eloquent fragrant frugal gracious hydraulic immersive inventive jovial lenient meticulous nimble nutritious outgoing persuasive pragmatic rigorous rustic seaside sincere stringent tactile unflappable vibrant wholesome zealous".split()

    given_names = "Brynn Dashiell Esperanza Ferdinand Gideon Hortense Ignacio Jolanta Kazimir Linnea Mateusz Nkechi Orsolya Philippa Rosamund Siobhan Tobias Vasily Winifred Zdenka".split()
    surnames = "Ashdown Bartholomew Cavallari Drummond Esterhazy Featherstone Gutmann Haverford Ishikawa Jorgensen Kowalczyk Lancaster Montague Nightshade Oyelaran Przybylski Rothschild Stravinsky Trevelyan Wyndham".split()
    streets = "Abbey Beacon Carlton Dovecote Elgin Furnace Gosling Harrow Inkerman Jasmine Kestrel Lodge Meridian Norfolk Oriel Pembroke Quaker Rosemary Sussex Tavistock".split()
    domains = "inbox.lv seznam.cz web.de mail.ru laposte.net telus.net tutanota.com gmail.com outlook.com".split()
    towns = "Odense Bergen Krakow Plovdiv Coimbra Girona Halifax Inverness Limerick Ostend Pisa Ravenna Seville Toledo Uppsala Vigo Winnipeg Zurich".split()
    known = 0.7
    before = {
        "NAME": "please let|we asked|you will work beside|thank you for writing to|an introduction to|the person in charge is|sent on by|approved by|supplied by|hand it over to|the trainer is|feel free to approach|as told by|yours faithfully,".split("|"),
        "EMAIL": "documents may be sent to|the mailbox is|apply through|get in touch:|drop a line to|copy in|found this sender:".split("|"),
        "PHONE": "give us a ring on|available by telephone on|leave a message at|the switchboard is|our line:|text back to|unknown caller".split("|"),
        "ADDRESS": "the workshop stands at|you will find us at|interviews take place at|please return the badge to|parcels go to|current residence|we have moved into".split("|"),
    }


def encoded(text: str, spans: list[tuple[int, int, str]]) -> tuple[np.ndarray, np.ndarray]:
    symbols = symbol_table()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    tags = np.zeros(len(text), np.int64)
    for a, b, kind in spans:
        k = KINDS.index(kind)
        tags[a] = 2 * k + 1
        tags[a + 1 : b] = 2 * k + 2
    return symbols[:LONGEST], tags[:LONGEST]


def common_words() -> np.ndarray:
    """Words that stand often in the grammar's rows, outside names and but for names, streets, domains and towns."""
    from collections import Counter

    maker, seen, lower = Maker(SEED - 1), Counter(), small_symbols()
    proper = {part for field in ("given_names", "surnames", "streets", "domains", "towns") for w in getattr(maker, field) for part in re.findall(r"[^\W_]+", w.lower())}
    proper -= set("com org net co de uk gmail mail".split())
    for _ in range(SAMPLE):
        text, spans = maker.example()
        symbols, tags = encoded(text, spans)
        if not len(symbols):
            continue
        tokens, data = Tokens(symbols, np.zeros(1, np.int64)), symbols.tobytes().translate(lower)
        name = KINDS.index("NAME")
        for a, b, tag in zip(tokens.begin.tolist(), tokens.end.tolist(), tags[tokens.begin].tolist()):
            if tag not in (2 * name + 1, 2 * name + 2) and b - a <= LETTERS:
                seen[data[a:b]] += 1
    table = symbol_table()
    left_out = {table[np.frombuffer(w.encode("utf-32-le"), np.uint32)].tobytes() for w in proper}
    digits = bytes(table[[ord(c) for c in "0123456789"]].tolist())
    return np.array(sorted(w for w, n in seen.items() if n >= OFTEN and w not in left_out and not w.strip(digits) == b""), "S")


def initial(rng: np.random.Generator, words: int) -> dict[str, np.ndarray]:
    s = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
    b = np.zeros((2, 4 * HIDDEN), np.float32)
    b[:, HIDDEN : 2 * HIDDEN] = 1
    normal = lambda n, d, by: (rng.standard_normal((n, d)) * by).astype(np.float32)
    return {
        "chars": normal(SIZE, CHAR, 0.5), "conv": s((2 * REACH + 1) * CHAR, CONV), "shift": np.zeros(CONV, np.float32), "word": normal(words + 1, WORD, 0.3), "form": normal(2 * SHAPES, FORM, 0.5),
        "wx": s(2, CONV + WORD + FORM, 4 * HIDDEN), "wh": s(2, HIDDEN, 4 * HIDDEN), "b": b, "wo": s(2 * HIDDEN, TAGS), "bo": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32), "first": np.zeros(TAGS, np.float32), "last": np.zeros(TAGS, np.float32),
    }


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def token_features(w: dict[str, np.ndarray], around: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Convolutions of tokens, their largest values' places, and the symbols' vectors. around: (tokens, characters, symbols
    around each)."""
    seen = w["chars"][around].reshape(*around.shape[:2], -1)
    sums = np.where((np.arange(around.shape[1]) < long[:, None])[:, :, None], seen @ w["conv"], np.float32(-1e9))
    place = sums.argmax(axis=1)
    return np.tanh(np.take_along_axis(sums, place[:, None, :], 1)[:, 0] + w["shift"]), place, seen


def loss_and_gradient(w: dict[str, np.ndarray], kinds: tuple[np.ndarray, ...], x: np.ndarray, y: np.ndarray, lengths: np.ndarray, kept: np.ndarray | float = 1.0) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log-likelihood of the tags and its gradient. kinds: symbols around the characters, length, word and form
    of every kind of token; x (kinds), y: (rows, time), padded with 0; kept: what the features are multiplied with."""
    n, t = x.shape
    h = HIDDEN
    live = (np.arange(t)[None, :] < lengths[:, None]).astype(np.float32)  # rows, time
    around, long, word, form = kinds
    most, place, seen = token_features(w, around, long)
    e = np.concatenate([most, w["word"][word], w["form"][form]], axis=1)[x] * kept  # rows, time, features
    pre = np.stack([(e.reshape(n * t, -1) @ w["wx"][side] + w["b"][side]).reshape(n, t, -1).transpose(1, 0, 2) for side in (0, 1)])
    pre[1] = pre[1, ::-1]  # the second direction runs backwards
    mask = np.stack([live.T, live.T[::-1]])[:, :, :, None]
    hs, cs, gates, tc = (np.zeros((t + 1, 2, n, h), np.float32) for _ in range(2)), None, np.zeros((t, 2, n, 4 * h), np.float32), np.zeros((t, 2, n, h), np.float32)
    hs, cs = hs
    for k in range(t):
        z = pre[:, k] + hs[k] @ w["wh"]
        g = np.empty_like(z)
        g[..., : 3 * h] = 0.5 * np.tanh(0.5 * z[..., : 3 * h]) + 0.5
        g[..., 3 * h :] = np.tanh(z[..., 3 * h :])
        c = g[..., h : 2 * h] * cs[k] + g[..., :h] * g[..., 3 * h :]
        tc[k] = np.tanh(c)
        m = mask[:, k]
        cs[k + 1], hs[k + 1] = c * m, g[..., 2 * h : 3 * h] * tc[k] * m
        gates[k] = g
    both = np.concatenate([hs[1:, 0], hs[1:, 1][::-1]], axis=2)  # time, rows, 2h
    em = both @ w["wo"] + w["bo"]  # time, rows, tags
    # CRF: forward and backward recursions
    alpha, beta = np.zeros_like(em), np.zeros_like(em)
    alpha[0] = w["first"] + em[0]
    for k in range(1, t):
        new = log_sum(alpha[k - 1][:, :, None] + w["trans"], 1) + em[k]
        alpha[k] = np.where(live[:, k, None] > 0, new, alpha[k - 1])
    total = log_sum(alpha[t - 1] + w["last"], 1)
    beta[t - 1] = w["last"]
    d_trans = np.zeros_like(w["trans"])
    for k in range(t - 2, -1, -1):
        step = em[k + 1] + beta[k + 1]
        new = log_sum(w["trans"][None] + step[:, None, :], 2)
        on = live[:, k + 1] > 0
        beta[k] = np.where(on[:, None], new, w["last"])
        pair = np.exp(np.minimum(0, alpha[k][:, :, None] + w["trans"] + step[:, None, :] - total[:, None, None]))
        d_trans += pair[on].sum(axis=0)
    marginal = np.exp(np.minimum(0, alpha + beta - total[None, :, None])) * live.T[:, :, None]
    rows = np.arange(n)
    gold = w["first"][y[:, 0]] + w["last"][y[rows, lengths - 1]] + (np.take_along_axis(em, y.T[:, :, None], 2)[..., 0] * live.T).sum(axis=0)
    inner = live[:, 1:] > 0
    gold = gold + (w["trans"][y[:, :-1], y[:, 1:]] * inner).sum(axis=1)
    np.subtract.at(d_trans, (y[:, :-1][inner], y[:, 1:][inner]), 1)
    d_em = marginal.copy()
    hot = np.zeros_like(em)
    np.put_along_axis(hot, y.T[:, :, None], 1, 2)
    d_em -= hot * live.T[:, :, None]
    d_first = np.exp(alpha[0] + beta[0] - total[:, None]).sum(axis=0)
    np.subtract.at(d_first, y[:, 0], 1)
    end = np.exp(alpha[lengths - 1, rows] + w["last"] - total[:, None])
    d_last = end.sum(axis=0)
    np.subtract.at(d_last, y[rows, lengths - 1], 1)
    grad = {"trans": d_trans, "first": d_first, "last": d_last, "wo": np.einsum("tnh,tnk->hk", both, d_em, optimize=True), "bo": d_em.sum(axis=(0, 1))}
    d_both = d_em @ w["wo"].T
    d_out = np.stack([d_both[:, :, :h], d_both[::-1, :, h:]], axis=1)  # time, side, rows, h
    d_pre = np.zeros((2, t, n, 4 * h), np.float32)
    d_h, d_c = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
    wh_t = w["wh"].transpose(0, 2, 1)
    for k in range(t - 1, -1, -1):
        m = mask[:, k]
        g = gates[k]
        dh = (d_h + d_out[k]) * m
        dc = d_c * m + dh * g[..., 2 * h : 3 * h] * (1 - tc[k] ** 2)
        z = d_pre[:, k]
        z[..., :h] = dc * g[..., 3 * h :] * g[..., :h] * (1 - g[..., :h])
        z[..., h : 2 * h] = dc * cs[k] * g[..., h : 2 * h] * (1 - g[..., h : 2 * h])
        z[..., 2 * h : 3 * h] = dh * tc[k] * g[..., 2 * h : 3 * h] * (1 - g[..., 2 * h : 3 * h])
        z[..., 3 * h :] = dc * g[..., :h] * (1 - g[..., 3 * h :] ** 2)
        d_h = z @ wh_t
        d_c = dc * g[..., h : 2 * h]
    grad["wh"] = np.einsum("tsnh,stnk->shk", hs[:-1], d_pre, optimize=True)
    grad["b"] = d_pre.sum(axis=(1, 2))
    d_pre[1] = d_pre[1, ::-1].copy()
    flat = d_pre.transpose(0, 2, 1, 3).reshape(2, n * t, -1)  # side, rows and times, gates
    grad["wx"] = e.reshape(n * t, -1).T @ flat
    d_e = ((flat @ w["wx"].transpose(0, 2, 1)).sum(axis=0).reshape(n, t, -1) * kept)[live > 0]
    which = x[live > 0]
    order = np.argsort(which, kind="stable")
    starts = np.flatnonzero(np.diff(which[order], prepend=-1))
    d_kind = np.zeros((len(long), d_e.shape[1]), np.float32)
    d_kind[which[order][starts]] = np.add.reduceat(d_e[order], starts, axis=0)
    c, v = w["conv"].shape[1], w["word"].shape[1]
    grad["word"], grad["form"] = np.zeros_like(w["word"]), np.zeros_like(w["form"])
    np.add.at(grad["word"], word, d_kind[:, c : c + v])
    np.add.at(grad["form"], form, d_kind[:, c + v :])
    d_most = d_kind[:, :c] * (1 - most**2)
    grad["shift"] = d_most.sum(axis=0)
    d_sums = np.zeros((*around.shape[:2], c), np.float32)
    np.put_along_axis(d_sums, place[:, None, :], d_most[:, None, :], 1)
    on = np.arange(around.shape[1]) < long[:, None]
    d_sums, seen = d_sums[on], seen[on]
    grad["conv"] = seen.T @ d_sums
    d_seen = (d_sums @ w["conv"].T).reshape(-1, w["chars"].shape[1])
    symbols = around[on].ravel()
    order = np.argsort(symbols, kind="stable")
    starts = np.flatnonzero(np.diff(symbols[order].astype(np.int64), prepend=-1))
    grad["chars"] = np.zeros_like(w["chars"])
    grad["chars"][symbols[order][starts]] = np.add.reduceat(d_seen[order], starts, axis=0)
    return float((total - gold).mean()), {k: v / n for k, v in grad.items()}


def batch_of(rows: list[tuple[np.ndarray, np.ndarray]], known: dict[bytes, int]) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray, np.ndarray]:
    """Kinds of tokens, kinds and tags by row and time, and lengths, of rows of symbols and tags with a token each."""
    size = np.array([len(a) for a, _ in rows])
    start = np.cumsum(size) - size
    symbols, tags = np.concatenate([a for a, _ in rows]), np.concatenate([b for _, b in rows])
    tokens = Tokens(symbols, start)
    of, seen = tokens.around()
    long = tokens.to - tokens.at
    i = np.arange(len(of)) - np.repeat(np.cumsum(long) - long, long)
    long = np.minimum(long, LETTERS)
    around = np.zeros((len(long), int(long.max()), 2 * REACH + 1), np.uint8)
    around[of[i < LETTERS], i[i < LETTERS]] = seen[i < LETTERS]
    row = np.searchsorted(start, tokens.begin, side="right") - 1
    lengths = np.bincount(row, minlength=len(rows))
    at = np.arange(len(row)) - (np.cumsum(lengths) - lengths)[row]
    x, y = np.zeros((len(rows), lengths.max()), np.int64), np.zeros((len(rows), lengths.max()), np.int64)
    x[row, at], y[row, at] = tokens.kind, tags[tokens.begin]
    return (around, long, tokens.words(known), tokens.form), x, y, lengths


class _Rows:
    """Rows of one process, in batches of about equal length."""

    def __init__(self, seed: int, known: dict[bytes, int]):
        self.maker, self.pool, self.order, self.known = Maker(seed), [], random.Random(SEED), known
        self.rng = np.random.default_rng(seed)

    def batch(self) -> tuple:
        if not self.pool:
            rows = sorted((p for p in (encoded(*self.maker.example()) for _ in range(ROWS * 12)) if len(p[0]) > 3 and (p[0] > 1).any()), key=lambda p: len(p[0]))
            self.pool = [rows[i : i + ROWS] for i in range(0, len(rows), ROWS)]
            self.order.shuffle(self.pool)  # the same order in all processes, so that they have rows of like lengths at a time
        (around, long, word, form), x, y, lengths = batch_of(self.pool.pop(), self.known)
        word = np.where(self.rng.random(len(word)) < UNKNOWN * self.rng.random(), 0, word)
        kept = (self.rng.random((*x.shape, CONV + WORD + FORM), np.float32) >= DROPPED) / np.float32(1 - DROPPED)
        return (around, long, word, form), x, y, lengths, kept


_rows: _Rows | None = None


def _begin(seeds, known) -> None:
    global _rows
    _rows = _Rows(seeds.get(), known)


def _step(w: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    return loss_and_gradient(w, *_rows.batch())


def train(minutes: float, path: str = WEIGHTS, seed: int = SEED, resume: bool = False, top_rate: float = 4e-3, workers: int = 8) -> None:
    import multiprocessing

    began = time.time()
    rng = np.random.default_rng(seed)
    w = dict(np.load(path)) if resume else {"words": common_words()}
    words = w.pop("words")
    known = {word: i + 1 for i, word in enumerate(words.tolist())}
    w = w or initial(rng, len(words))
    print(f"{len(words)} known words, {time.time() - began:.0f} s", flush=True)
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    kept = {k: a.copy() for k, a in w.items()}
    context = multiprocessing.get_context("fork")
    seeds = context.Queue()
    for i in range(workers):
        seeds.put(1000 * seed + i)
    step, mean = 0, None
    with context.Pool(workers, _begin, (seeds, known)) as pool:
        while (done := (time.time() - began) / (60 * minutes)) < 1:
            results = pool.map(_step, [w] * workers, chunksize=1)
            loss = float(np.mean([a for a, _ in results]))
            grad = {k: np.mean([g[k] for _, g in results], axis=0) for k in w}
            step += 1
            norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            clip = min(1.0, 5.0 / (norm + 1e-9))
            rate = top_rate * min(1, step / 50) * (1 - done) ** 0.8 + 1e-5
            keep = min(KEPT, step / (step + 9))
            for k in w:
                g = grad[k] * clip
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = (w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                kept[k] = (keep * kept[k] + (1 - keep) * w[k]).astype(np.float32)
            mean = loss if mean is None else 0.97 * mean + 0.03 * loss
            if step % 200 == 0:
                print(f"{step} {time.time() - began:.0f} s loss {mean:.3f}", flush=True)
                np.savez_compressed(path, words=words, **kept)
    np.savez_compressed(path, words=words, **kept)


def figures(rows: int = 3000, seed: int = 77) -> dict[str, tuple[float, float, int]]:
    """Precision, recall and number of true spans by kind on the held-out grammar, through the whole operator, a
    finding being right only if kind, start and end are."""
    import pyarrow as pa

    from sievework.llm.pii import found_in

    maker = HeldOut(seed)
    made = [maker.example() for _ in range(rows)]
    got = {(r, a, b, k) for r, a, b, k, _ in found_in(pa.array([t for t, _ in made]))}
    true = {(i, a, b, k) for i, (_, spans) in enumerate(made) for a, b, k in spans}
    out = {}
    for kind in KINDS:
        g, t = {x for x in got if x[3] == kind}, {x for x in true if x[3] == kind}
        out[kind] = (len(g & t) / max(1, len(g)), len(g & t) / max(1, len(t)), len(t))
    return out


if __name__ == "__main__":
    again = sys.argv[2:] == ["resume"]
    if float(sys.argv[1] if len(sys.argv) > 1 else 10):
        train(float(sys.argv[1]) if len(sys.argv) > 1 else 10, seed=SEED + again, resume=again, top_rate=2e-3 if again else 4e-3)
    for kind, (precision, recall, n) in figures().items():
        print(f"{kind} precision {precision:.3f} recall {recall:.3f} of {n}")
