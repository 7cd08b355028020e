"""Texts written and labelled by hand: (prose, text)."""

TEXTS = [
    (True, "The town council will hire a firm to paint the school during the summer holidays. Work must end before the first of September, and every room has to be left clean and ready for use."),
    (True, "Se contrata la limpieza del colegio durante los meses de verano. La empresa tendrá que dejar las aulas listas antes del inicio del curso, según el calendario que apruebe la dirección."),
    (True, "La biblioteca abre todos los días laborables. Quien pierda un libro tendrá que pagar su precio, y no podrá llevarse otro hasta que lo haga."),
    (True, "El mercat obre cada dia a les vuit del matí. Les parades han de quedar netes abans de tancar, i l'ajuntament ho comprovarà cada setmana sense avisar."),
    (True, "O concello contratará unha empresa para coidar os xardíns. O persoal terá que levar uniforme e deixar as ferramentas no almacén ao rematar a xornada."),
    (True, "Udalak enpresa bat kontratatuko du parkeak zaintzeko. Langileek uniformea eraman beharko dute eta tresnak gordeta utzi lana amaitu ondoren."),
    (True, "La mairie recrute une entreprise pour entretenir les jardins. Le personnel doit porter un uniforme et ranger les outils dans le dépôt à la fin de la journée."),
    (True, "LA OFICINA ABRE DE LUNES A VIERNES POR LA MAÑANA. QUIEN QUIERA PRESENTAR UNA SOLICITUD TENDRÁ QUE TRAER SU DOCUMENTO DE IDENTIDAD Y UNA COPIA."),
    (True, "Los camiones no podrán\nentrar en el centro por\nla noche. El ruido\nmolesta a los vecinos, y\nla ordenanza lo prohíbe\ndesde hace diez años."),
    (True, "1.1. El contrato empieza el día de su firma y dura dos años.\n1.2. Cualquiera de las partes podrá terminarlo con un aviso de tres meses, sin pagar nada a la otra."),
    (True, "MEMORIA\n\nEl puente viejo no soporta el peso de los autobuses. Por eso se propone construir uno nuevo unos metros más arriba, donde el río es más estrecho."),
    (True, "The tender is open to all. Bids above 20.000,00 euros will not be read, and late ones go back to the sender unopened."),
    (True, "Si llueve, la fiesta se celebrará en el pabellón. En caso contrario, tendrá lugar en la plaza, como todos los años."),
    (True, "Chaque classe reçoit un ordinateur et une imprimante. Les enseignants peuvent demander du papier au secrétariat tant que le budget le permet."),
    (False, "mesa;4;120,00\nsilla;16;35,50\narmario;2;410,00\nlámpara;9;22,15\nestante;7;64,90\npizarra;3;88,00"),
    (False, "| A1 | ladrillos | 400 | 0,35 |\n| A2 | cemento | 22 | 7,80 |\n| A3 | arena | 9 | 15,00 |\n| A4 | tejas | 150 | 1,10 |"),
    (False, "Código\tNombre\tPrecio\n001\tgoma\t0,30\n002\tlápiz\t0,45\n003\tregla\t1,20\n004\tcuaderno\t2,75"),
    (False, "- pintura de las paredes\n- cambio de las ventanas\n- reparación del tejado\n- limpieza de los canalones\n- retirada de los escombros"),
    (False, "a) la pintura de las aulas.\nb) el cambio de las puertas.\nc) la reparación del tejado.\nd) limpieza de los patios.\ne) retirada de escombros."),
    (False, "Ref. 10021 bancos de madera para el parque 12 uds\nRef. 10034 papeleras de metal con tapa 40 uds\nRef. 10077 farolas de luz blanca 8 uds\nRef. 10102 fuentes de piedra 2 uds"),
    (False, "Nombre: Ana\nEdad: 41\nCiudad: Vigo\nNombre: Iker\nEdad: 35\nCiudad: Bilbao\nNombre: Pau\nEdad: 28\nCiudad: Reus"),
    (False, "Introducción ............ 3\nObjeto ............ 5\nPlazos ............ 8\nPrecio ............ 11\nAnexos ............ 20"),
    (False, "Page 1 of 9\nPage 2 of 9\nPage 3 of 9\nPage 4 of 9\nPage 5 of 9\nPage 6 of 9\nPage 7 of 9"),
    (False, "zX8qLm2PvR0tKd7YwB5nJc3HgF9sAeU1oTiQy6VxZr4MlNkDpWbGjCfE+hS/0aOuI8vX2qLmPvR0tKd7YwB5nJc3HgF9sAeU1oTi=="),
    (False, "no no no no no no no no no no no no no no no no no no no no no no no no no no no no no no no no"),
    (False, "L a o f i c i n a a b r e p o r l a m a ñ a n a . E l r e g i s t r o c i e r r a a l a s d o s ."),
    (False, "L© ±fic™na ½br€ po¬ ¿a mañÂn™. €l re©istr± ci½rra ¬ las ™os, y q™ien l¿€gue t©rde t½ndrá que v±lv€r."),
    (False, "@#;;<>{}~~ ^^%$ //\\\\ ||=+ __-- ;;:: ??!! &&&& ^%#@ ~{}<>| =+_- ;:?! /\\|~ {}[]<> %%## @@"),
    (False, "tornillos (40 uds); tuercas (40 uds); arandelas (80 uds); clavos (200 uds); tacos (60 uds); bisagras (12 uds)"),
    (False, "Pintura de las paredes\nCambio de las ventanas\nReparación del tejado\nLimpieza de los canalones\nRetirada de los escombros"),
]
