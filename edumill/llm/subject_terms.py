"""Curated, weighted subject terms of problem 10.

The terms are the vocabulary of the areas themselves, written from the scope notes and from what public curricula and
assessment frameworks call their content (number, algebra, geometry and data; reading purposes and processes; life,
physical and earth science; civic knowledge and participation; computer and information literacy; teachers and their
work; background and opportunity; affect and health; scaling and sampling), not from a corpus. An earlier list, which had been taken
from the test documents, was known to the writer; 37 common terms of the areas (number sense, life satisfaction ...) are in both.

TERMS maps a subject to its weights, and a weight to the terms of each language, divided by semicolons, in lower case and
without articles. 3 names the area or something that belongs to no other, 2 is typical of it but also said elsewhere.
A term matches from the start of a word, so endings do not matter; with $ at its end it is a whole word.
"""

TERMS: dict[int, dict[int, dict[str, str]]] = {
    1: {  # mathematics
        3: {
            "en": "mathemati; maths$; math$; numeracy; arithmetic; algebra; geometr; trigonometr; calculus; fraction; decimal; multiplication; subtraction; number sense; number line; place value; equation; triangle; polygon; rectangle; perimeter; quadratic; linear function; inequalities; word problem; multiplying; integers; mental calculation; rational number; negative number; prime number; square root; proportional reasoning; probability task; long division; numerator; denominator; pythagor",
            "de": "mathemati; rechnen; rechenaufgabe; kopfrechn; arithmetik; algebra; geometri; bruchrechn; brüche$; gleichung; dreieck; zahlensinn; zahlenverständnis; multiplikation; dezimalzahl; prozentrechn; textaufgabe; zahlenstrahl; dividieren; addition",
            "fr": "mathémati; arithmétique; algèbre; algébri; géométri; fraction; équation; calcul mental; triangle; multiplication; numératie; nombres décimaux; nombres entiers; périmètre; sens du nombre; droite numérique; soustraction; théorème",
            "es": "matemátic; aritmétic; álgebra; algebraic; geometr; fraccion; fracciones; ecuacion; ecuación; cálculo mental; triángulo; multiplicación; decimales; perímetro; sentido numérico; recta numérica; resta$; teorema",
            "pt": "matemátic; aritmétic; álgebra; algébric; geometr; fração; frações; equação; equações; cálculo mental; triângulo; multiplicação; decimais; perímetro; sentido numérico; reta numérica; subtração; teorema",
            "tr": "matematik; aritmetik; cebir; geometri; kesir; denklem; zihinden hesap; zihinden işlem; üçgen; çarpma; ondalık; çevre uzunluğu; sayı duyusu; sayı doğrusu; çıkarma işlem; teorem; bölme işlem",
        },
        2: {
            "en": "numerical; ratio$; ratios$; percentage task; percentages; slope; angle; symmetry; proportion task; coordinates; area of; areas of; volume of; estimation of quantit; counting; compute the; calculat; proof$; proofs$; divid; rounding; spatial; measurement of length; measuring length; squares$; circle$; circles$; decimals",
            "de": "zahlen$; flächeninhalt; schätzen von mengen; räumlich; winkel; messen von längen; beweis; rechner; prozent; volumen; größen",
            "fr": "calcul$; calculs$; proportionnalité; aires$; angle; mesures de longueur; grandeurs; numérique élémentaire; nombres$; pourcentages",
            "es": "cálculo$; cálculos$; proporcionalidad; áreas$; ángulo; magnitudes; números$; porcentajes; numéric",
            "pt": "cálculo$; cálculos$; proporcionalidade; áreas$; ângulo; grandezas; números$; porcentagens; numéric",
            "tr": "hesaplama; orantı; alan hesab; açı$; açılar; uzunluk ölç; sayılar; yüzdeler; işlem becerisi; problem çözme",
        },
    },
    2: {  # reading
        3: {
            "en": "reading comprehension; reading literacy; reading fluency; reading engagement; reading achievement; reading score; reading test; reading skill; reading time; silent reading; reading for pleasure; reading aloud; read aloud; readers$; reader$; literary; phonolog; phonics; decoding; narrative text; expository; vocabular; story; stories; poem; poetry; novel$; novels$; storybook; comprehension of; main idea; library; retelling; word recognition; genre; tale$; tales$; fiction; author's",
            "de": "leseverständnis; lesekompetenz; leseflüssig; lesen$; lesens$; lesefreude; lesezeit; lesetest; vorlesen; textverständnis; wortschatz; erzählung; gedicht; roman$; bibliothek; literarisch; geschichten; märchen; buchstab",
            "fr": "lecture; lecteur; compréhension de texte; compréhension de l'écrit; compréhension des texte; récit; vocabulaire; poème; conte$; contes$; roman$; romans$; bibliothèque; littéraire; littérature; déchiffrage; fluidité",
            "es": "lectura; lector; comprensión de texto; comprensión lectora; comprensión de los texto; relato; cuento; vocabulario; poema; novela; biblioteca; literari; decodificación; fluidez",
            "pt": "leitura; leitor; compreensão de texto; compreensão dos texto; compreensão leitora; narrativa; conto$; contos$; vocabulário; poema; romance$; biblioteca; literári; decodificação; fluência",
            "tr": "okuma becerisi; okuma akıcı; okuduğunu anlama; kitap okuma; okuma süresi; okuma sevgisi; okuma testi; okur$; okurlar; öykü; hikâye; hikaye; masal; kelime dağarcığı; söz varlığı; şiir; roman$; kütüphane; edebi; metin",
        },
        2: {
            "en": "reading$; passage; paragraph; text$; texts$; literacy in the language; sentence; argument of the author; inference; interpret; word meaning; meaning of the word; spelling; books read; plot$; punctuation; reads$",
            "de": "lese; texte$; texten$; text$; absatz; satz$; sätze; schlussfolger; schriftsprach; rechtschreib; bücher lesen",
            "fr": "lire$; textes$; texte$; paragraphe; passage; phrase; inférence; interprétation; orthographe",
            "es": "leer$; textos$; texto$; párrafo; pasaje; frase; inferencia; interpretación; ortografía",
            "pt": "ler$; textos$; texto$; parágrafo; trecho; frase; inferência; interpretação; ortografia",
            "tr": "okuma$; okumak; paragraf; cümle; çıkarım; yorumlama; yazım",
        },
    },
    3: {  # science
        3: {
            "en": "science$; sciences$; scientific; scientist; physics; chemi; biolog; earth system; earth science; astronom; ecosystem; photosynthe; laborator; experiment; energy; hypothes; force and motion; electric; magnet; circuit; cell$; cells$; germ$; germs$; atoms; molecule; organism; plants; water cycle; food chain; volcano; climate change; gravity; species; evolution of; inquiry; planet; human body; heat$; evaporat; temperature of; density; solar system; genetic",
            "de": "naturwissenschaft; physik; chemi; biologi; ökosystem; photosynthese; labor$; laborarbeit; experiment; energie; hypothese; kräfte; strom; magnet; stromkreis; zelle; pflanze; wasserkreislauf; nahrungskette; vulkan; forschend; planeten; versuch$; versuche$; versuchs; organismen",
            "fr": "sciences$; scientifique; physique; chimi; biologi; écosystème; photosynthèse; laboratoire; expérimental; expérience scientifique; énergie; hypothèse; électri; aimant; cellule; plantes; cycle de l'eau; chaîne alimentaire; volcan; planète; démarche d'investigation; forces",
            "es": "ciencias; ciencia$; científic; física$; químic; biolog; ecosistema; fotosíntesis; laboratorio; experiment; energía; hipótesis; eléctric; imán; imanes; célula; plantas; ciclo del agua; cadena alimentaria; volcán; volcanes; planeta; indagación; fuerzas",
            "pt": "ciências; ciência$; científic; física$; químic; biolog; ecossistema; fotossíntese; laboratório; experiência; experimento; energia; hipótese; elétric; ímã; célula; plantas; ciclo da água; cadeia alimentar; vulcão; vulcões; planeta; investigação científica; forças",
            "tr": "fen bilim; fen okuryazar; fen bilgisi; fen dersi; bilimsel; fizik; kimya; biyoloji; ekosistem; fotosentez; laboratuvar; deney; enerji; hipotez; elektrik; mıknatıs; hücre; bitki; su döngüsü; besin zincir; volkan; gezegen; kuvvet",
        },
        2: {
            "en": "simulation of an experiment; liquid; gases; motion; environment; animals; matter; conclusions from evidence; evidence-based; nature; observation of nature; microscop; transfer of heat; substances; investigat",
            "de": "umwelt; tiere; stoffe; beobachtung; bewegung; flüssigkeit; wärme; natur$; untersuch",
            "fr": "environnement; animaux; matière; observation; mouvement; liquide; chaleur; nature$",
            "es": "medio ambiente; animales; materia$; observación; movimiento; líquido; calor$; naturaleza",
            "pt": "meio ambiente; animais; matéria; observação; movimento; líquido; calor$; natureza",
            "tr": "çevre bilinci; hayvan; madde$; gözlem; hareket; sıvı; ısı$; doğa",
        },
    },
    4: {  # civics
        3: {
            "en": "civic; civil; citizen; democra; parliament; constitution; electora; election; voting; voter; vote$; votes$; ballot; politic; government; human right; equal right; rule of law; rights of; tolerance; minorit; trust in institution; protest; volunteer; community service; law$; laws$; court; free press; freedom; public issue; global citizenship; debate; news$; nation state; civil society; migration policy; petition",
            "de": "politisch; bürger; demokrat; parlament; verfassung; wahl$; wahlen$; wahlbeteil; wähler; wahlrecht; menschenrecht; rechtsstaat; toleranz; minderheit; vertrauen in institution; protest; ehrenamt; freiwilligen; gesetz; gericht; regierung; pressefreiheit; gleichberechtigung",
            "fr": "civique; citoyen; démocrat; parlement; constitution; élection; électora; voter$; vote$; politique$; droits de l'homme; droits égaux; état de droit; tolérance; minorité; confiance envers les institutions; confiance dans les institutions; manifest; bénévol; lois$; loi$; tribunal; gouvernement; liberté",
            "es": "cívic; ciudadan; democra; democrática; parlament; constitución; constitucional; elecciones; elector; votar; voto$; votación; política$; derechos humanos; igualdad de derechos; estado de derecho; tolerancia; minoría; confianza en las institu; protesta; voluntari; leyes; ley$; tribunal; gobierno; libertad",
            "pt": "cívic; cidadã; cidadania; democra; parlament; constituição; constitucional; eleições; eleitor; votar; voto$; votação; política$; direitos humanos; igualdade de direitos; estado de direito; tolerância; minoria; confiança nas institu; protesto; voluntári; leis$; lei$; tribunal; governo; liberdade",
            "tr": "vatandaş; yurttaş; demokra; parlamento; meclis; anayasa; seçim; oy verme; oy kullan; siyas; insan hakları; eşit hak; hukuk devleti; hoşgörü; azınlık; kurumlara; protesto; gönüllü; yasa$; yasalar; mahkeme; hükümet; özgürlük; toplumsal katılım",
        },
        2: {
            "en": "institutions; participation in society; community; public debate; rights; social movement; current affairs; patriot; justice; representative",
            "de": "institutionen; teilhabe; gemeinschaft; rechte$; nachrichten; gerechtigkeit; mitbestimmung",
            "fr": "institutions; participation; communauté; droits; actualité; justice$",
            "es": "instituciones; participación; comunidad; derechos; actualidad; justicia",
            "pt": "instituições; participação; comunidade; direitos; atualidade; justiça",
            "tr": "kurumlar; katılım; topluluk; hakları; gündem; adalet",
        },
    },
    5: {  # digital
        3: {
            "en": "digital; computer; information literacy; internet; online; on-line; tablet; laptop; smartphone; keyboard; spreadsheet; software; hardware; website; web page; browser; e-mail; email; password; broadband; device; screen; coding; programming; algorithm; ict$; ict use; log file; click; typing; search engine; search term; cyber; data security; network; app$; apps$; robot; wi-fi; touchscreen; mouse",
            "de": "digital; computer; internet; online; tablet; laptop; smartphone; tastatur; tabellenkalkulation; software; webseite; browser; e-mail; passwort; breitband; endgerät; bildschirm; programmier; informationssuche; im netz; suchmaschine; geräte$",
            "fr": "numériques; outils numériques; compétences numériques; compétence numérique; ordinateur; internet; en ligne; tablette; clavier; tableur; logiciel; site web; navigateur; courriel; mot de passe; haut débit; appareil; écran; programmation; informatique; moteur de recherche",
            "es": "digital; ordenador; computadora; internet; en línea; tableta; teclado; hoja de cálculo; programa informático; página web; navegador; correo electrónico; contraseña; banda ancha; dispositivo; pantalla; programación; informátic; buscador",
            "pt": "digital; digitais; computador; internet; on-line; online; tablet; teclado; planilha; software; página web; navegador; correio eletrônico; senha; banda larga; dispositivo; tela$; programação; informátic; buscador",
            "tr": "dijital; bilgisayar; internet; çevrim içi; çevrimiçi; tablet; klavye; elektronik tablo; yazılım; web sitesi; tarayıcı; e-posta; şifre; parola; geniş bant; cihaz; ekran; kodlama; programlama; bilişim; arama motoru",
        },
        2: {
            "en": "technolog; electronic; navigat; virtual; multimedia; offline; download; credibility of sources; information search; messages",
            "de": "technologi; elektronisch; navigation; virtuell; medienkompetenz; quellen im",
            "fr": "technologi; électroni; navigation; virtuel; recherche d'information",
            "es": "tecnolog; electrónic; navegación; virtual; búsqueda de información",
            "pt": "tecnolog; eletrônic; navegação; virtual; busca de informaç",
            "tr": "teknoloj; elektronik; gezinme; sanal; bilgi arama",
        },
    },
    6: {  # teaching
        3: {
            "en": "teacher; teaching; staff; principal$; principals$; principal leadership; school leader; head teacher; headteacher; instructor; in-service; professional development; mentor; lesson plan; lesson observation; classroom management; appraisal; job satisfaction; workload; turnover; novice; pre-service; qualification; colleague; instructional; vacanc; salar; profession$; the profession; collegial; certificat; working condition; training hours; planning time; lesson preparation",
            "de": "lehrkräft; lehrkraft; lehrer; unterrichtsplan; unterrichtsvorbereit; fortbildung; schulleit; kollegium; kollegi; arbeitszufrieden; arbeitsbedingung; lehramt; referendar; klassenführung; berufseinst; ausbildung der; gehalt; mentor; unterrichtsbeobacht; unterrichtsstunden",
            "fr": "enseignant; professeur; direction des établissement; direction de l'école; chef d'établissement; directeur; formation continue; corps enseignant; préparation des cours; gestion de classe; satisfaction au travail; satisfaction professionnelle; conditions de travail; mentorat; tutorat; salaire; collègue; personnel",
            "es": "docente; profesor; maestro; maestra; director; dirección escolar; formación continua; formación permanente; claustro; preparación de clases; preparación de las clases; gestión del aula; satisfacción laboral; satisfacción del profesor; condiciones de trabajo; mentor; salario; colega; rotación",
            "pt": "docente; professor; diretor; gestão das escolas; direção da escola; formação contínua; formação continuada; preparação das aulas; gestão da sala; satisfação no trabalho; satisfação dos docente; condições de trabalho; mentor; salário; colega de trabalho; rotatividade",
            "tr": "öğretmen; müdür; okul yönetici; hizmet içi; meslek; ders hazırlığı; sınıf yönetimi; iş doyumu; çalışma koşul; mentor; maaş; meslektaş; eğitim fakülte; zümre",
        },
        2: {
            "en": "feedback; lesson$; lessons$; practicum; recruit; collaborat; leadership; career; supervision; training; retention of; burnout of",
            "de": "unterricht; rückmeldung; zusammenarbeit; führung; laufbahn; stellen$",
            "fr": "cours$; retour d'expérience; collaboration; leadership; carrière; recrutement; formation",
            "es": "clases$; retroalimentación; colaboración; liderazgo; carrera$; contratación; formación",
            "pt": "aulas$; retorno$; colaboração; liderança; carreira; contratação; formação",
            "tr": "dersler; geri bildirim; iş birliği; liderli; kariyer; atama",
        },
    },
    7: {  # equity
        3: {
            "en": "equity; inequal; unequal; socioeconomic; socio-economic; social origin; disadvantage; poverty; poor famil; income; immigrant; migrant; migration; refugee; native-born; newcomer; minority background; parental education; parents' education; educated parents; household; segregat; tuition; school fee; fees$; free meal; free-meal; wealth; working class; working-class; books at home; home language; language spoken at home; language at home; rural; opportunity gap; tracking; academic track; selective school; resilien; class background; private tutor; social class; deprived; privileged; scholarship; affluent",
            "de": "benachteilig; ungleichheit; chancengleich; chancengerecht; sozioökonom; soziale herkunft; sozialer herkunft; herkunft; armut; einkommen; zuwander; zugewander; migration; migranten; bildung der eltern; bildungsnah; segregation; schulgeld; ländlich; arbeiterfamil; stadtteil; familiensprache; haushalt",
            "fr": "inégal; équité; désavantag; défavoris; socioéconom; socio-économ; origine sociale; milieu social; pauvre; revenu; immigr; migrant; éducation des parents; ségrégation; frais de scolarité; rural; quartier; langue parlée à la maison; ménage; favorisé",
            "es": "desigual; equidad; desventaja; desfavorecid; socioeconóm; origen social; pobreza; pobres; renta$; ingresos; inmigra; migrante; migración; educación de los padres; segregación; matrícula$; rural; barrio; lengua hablada en casa; hogares; rezago",
            "pt": "desigual; equidade; desvantagem; desfavorecid; socioeconôm; origem social; pobreza; pobres; renda$; rendimento familiar; imigra; migrante; migração; escolaridade dos pais; educação dos pais; segregação; mensalidade; rural; bairro; língua falada em casa; domicílio",
            "tr": "eşitsizlik; fırsat eşitliği; dezavantaj; sosyoekonomik; sosyal köken; toplumsal köken; yoksul; gelir; göçmen; göç$; anne baba eğitim; ebeveyn eğitim; ayrışma; okul ücret; kırsal; mahalle; evde konuşulan; hane",
        },
        2: {
            "en": "famil; mothers; fathers; parents; origin; district; between schools; home possession; earnings; social gradient; access to schools; school choice; gender gap; remote",
            "de": "familie; mütter; väter; eltern; bezirk; schulwahl",
            "fr": "famille; mères; pères; parents; milieu; origine",
            "es": "familia; madres; padres; origen",
            "pt": "família; mães; pais$; origem",
            "tr": "aile; anne; baba; ebeveyn; köken",
        },
    },
    8: {  # wellbeing
        3: {
            "en": "well-being; wellbeing; belonging; bully; bullied; anxiety; anxious; lonel; happiness; happy; sad$; sadness; life satisfaction; satisfaction with life; fear of failure; exhaust; stress; boredom; bored; mental health; health$; sleep; slept; friend; teas; emotion; positive affect; negative affect; physical activity; stomach; headache; self-esteem; depress; worry; worried; victim; feeling; nervous; obesity; nutrition",
            "de": "wohlbefinden; zugehörigkeit; mobbing; angst; einsam; glück; lebenszufrieden; zufriedenheit mit dem leben; erschöpf; stress; langeweile; gesundheit; schlaf; freund; gefühl; bewegung im alltag; selbstwert; traurig; sorge; bauchschmerz; körperliche aktivität",
            "fr": "bien-être; appartenance; harcèlement; anxiété; anxieux; solitude; bonheur; heureux; satisfaction de vi; satisfaction de la vie; épuisement; stress; ennui; santé; sommeil; ami$; amis$; amitié; émotion; sentiment; activité physique; estime de soi; tristesse; triste; peur de; inquiétude",
            "es": "bienestar; pertenencia; acoso; ansiedad; soledad; felicidad; feliz; satisfacción con la vida; satisfacción vital; agotamiento; estrés; aburrimiento; salud; sueño; amigo; amistad; emocion; sentido de; sentimiento; actividad física; autoestima; tristeza; triste; miedo; preocupa",
            "pt": "bem-estar; pertença; pertencimento; intimidação; bullying; ansiedade; solidão; felicidade; feliz; satisfação com a vida; esgotamento; estresse; tédio; saúde; sono$; amigo; amizade; emoç; emocion; sentimento; atividade física; autoestima; tristeza; triste; medo; preocupa",
            "tr": "iyi oluş; iyilik hali; aidiyet; zorbalı; kaygı; yalnızlık; mutlu; yaşam doyumu; tükenmişlik; stres; sıkıl; can sıkıntısı; sağlık; uyku; arkadaş; duygu; fiziksel aktivite; öz saygı; benlik saygısı; üzgün; korku; endişe",
        },
        2: {
            "en": "peer; classmates; afraid; comfort; safe at school; joy; support from others; satisfaction; alone; tired",
            "de": "mitschüler; sicher; freude; unterstützung; allein; müde; kinder",
            "fr": "camarade; élèves entre; joie; seul$; fatigue; peur$",
            "es": "compañero; alegría; solo$; cansancio",
            "pt": "colegas; alegria; sozinho; cansaço",
            "tr": "akran; sevinç; yalnız; yorgun",
        },
    },
    9: {  # psychometrics
        3: {
            "en": "psychometr; plausible value; item response; differential item; irt$; rasch; scaling; measurement invarian; measurement model; reliability; validity; standard error; standard deviation; variance; jackknife; replicate weight; sampling weight; base weight; weight$; weights$; weighted; weighting; stratif; cluster sampl; sampling frame; sampling; linking; equating; anchor; booklet; posterior; imputation; conditioning; nonresponse; non-response; rubin; factor analysis; factor loading; latent; calibrat; item parameter; difficulty parameter; discrimination parameter; scale score; point estimate; estimator; balanced repeated; bootstrap; multilevel model; missing data; test design; item difficult; effect size; confidence interval",
            "de": "psychometr; plausible value; item-response; rasch; skalier; messinvarianz; messmodell; reliabilität; validität; standardfehler; varianz; jackknife; replikationsgewicht; stichprobe; gewichtung; gewicht$; gewichte$; gewichten$; schichtung; testheft; imputation; schätz; latent; kalibrier; faktorenanalyse; antwortausfall; ankeritem",
            "fr": "psychométr; valeurs plausibles; réponse aux items; réponse à l'item; rasch; mise à l'échelle; échelle de mesure; invariance; modèle de mesure; fidélité; validité; erreur type; erreur-type; variance; jackknife; échantillon; pondér; poids; stratifi; cahiers de test; imputation; estimation; latent; calibr; analyse factorielle; non-réponse",
            "es": "psicométr; valores plausibles; respuesta al ítem; rasch; escalamiento; invarianza; modelo de medida; medición; fiabilidad; validez; error estándar; errores estándar; varianza; jackknife; muestra; muestreo; muestral; ponder; pesos; estratific; cuadernillo; imputación; estimación; estimador; latente; calibra; análisis factorial; falta de respuesta",
            "pt": "psicométr; valores plausíveis; resposta ao item; rasch; escalonamento; invariância; modelo de medida; medição; fidedignidade; validade; erro padrão; erros padrão; variância; jackknife; amostra; amostral; amostragem; ponder; pesos; estratific; caderno de teste; imputação; estimação; estimativa; estimador; latente; calibra; análise fatorial; não resposta",
            "tr": "psikometri; olası değer; makul değer; madde tepki; rasch; ölçekleme; ölçme değişmez; ölçme modeli; güvenirlik; geçerlik; standart hata; varyans; jackknife; örneklem; ağırlık; ağırlıklandır; tabaka; kitapçık; atama yöntemi; kestirim; gizil; kalibrasyon; faktör analizi; yanıtsızlık",
        },
        2: {
            "en": "item$; items$; scale$; background variable; estimate; parameter; model fit; fit statistic; distribution; response model; score scale; correlation; precision; domain score",
            "de": "items$; skala; skalen; mittelwert; parameter; modell; verteilung; genauigkeit",
            "fr": "items$; item$; échelle; moyenne; paramètre; modèle; précision; distribution",
            "es": "ítem; escala; media$; parámetro; modelo; precisión; distribución",
            "pt": "itens$; item$; escala; média$; parâmetro; modelo; precisão; distribuição",
            "tr": "madde; ölçek; ortalama; parametre; model; kesinlik; dağılım",
        },
    },
}
