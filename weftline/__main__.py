from weftline.cli import main

main()
