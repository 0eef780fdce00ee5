-- Nations and customers of each region; a semicolon in a comment; and one in a text.
SELECT r_name, COUNT(DISTINCT n_nationkey) AS nations, COUNT(c_custkey) AS customers, 'a;b' AS mark
FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey
GROUP BY r_name;
